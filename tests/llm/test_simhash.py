"""SimHash components against plain comparison of all pairs."""

import random
import re

import pytest
import xxhash

from tandem.llm import simhash
from tests.llm.conftest import AWKWARD, SF


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """Fingerprint and component of each row with an id, by comparing all pairs of different fingerprints."""
    parent = {}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    held = {}
    for doc, text in rows:
        if doc is not None:
            held.setdefault(plain_print(text), set()).add(doc)
            parent.setdefault(doc, doc)
    prints = list(held)
    joined = [(a, b) for i, a in enumerate(prints) for b in prints[i:] if (a ^ b).bit_count() <= 2]
    for a, b in joined:
        docs = sorted(held[a] | held[b])
        for doc in docs[1:]:
            x, y = top(docs[0]), top(doc)
            parent[max(x, y)] = min(x, y)
    return sorted((doc, f"{plain_print(text):016x}", top(doc)) for doc, text in rows if doc is not None)


def got(df):
    return sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in df.collect() if r["doc_id"] is not None)


def near_copies(count, seed):
    rng = random.Random(seed)
    words = [f"w{rng.randrange(10_000)}" for _ in range(3000)]
    out = []
    for _ in range(count):
        copy = list(words)
        copy[rng.randrange(len(copy))] = f"x{rng.randrange(10_000)}"
        out.append(" ".join(copy))
    return out


def test_awkward_rows(spark, awkward, nothing):
    assert got(simhash.near_duplicates(awkward)) == plain_components(AWKWARD)
    lost = [r for r in simhash.near_duplicates(awkward).collect() if r["doc_id"] is None]
    assert len(lost) == 1 and lost[0]["component_id"] is None and lost[0]["fingerprint"] == f"{plain_print('a b c d e f g h i j'):016x}"
    assert simhash.near_duplicates(nothing).collect() == []


def test_an_id_with_several_texts_joins_their_groups(spark):
    rows = [(5, "one two three four"), (9, "one two three four"), (9, "five six seven eight"), (12, "five six seven eight"), (20, None), (30, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert got(simhash.near_duplicates(df)) == plain_components(rows)
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df).collect()} == {5: 5, 9: 5, 12: 5, 20: 20, 30: 20}


@pytest.mark.parametrize("paired", [2, 64])
def test_crowded_buckets_lose_no_link(spark, monkeypatch, paired):
    monkeypatch.setattr(simhash, "PAIRED", paired)
    texts = near_copies(60, 1) + near_copies(60, 2) + ["same text here"] * 40
    rows = list(enumerate(texts, 1))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert got(simhash.near_duplicates(df)) == plain_components(rows)


def test_tables_hold_every_close_pair():
    rng = random.Random(3)
    for count in (10, 1 << 23, 1 << 33, 1 << 36):
        masks = simhash.tables(count, 2)
        for _ in range(300):
            a = rng.getrandbits(64)
            b = a ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
            assert any(a & m == b & m for m in masks)


def test_long_text_in_blocks():
    text = " ".join(f"Word{i % 977}" for i in range(400_000))
    assert len(text) > 2 << 20 and simhash.fingerprint(text.encode()).hex() == f"{plain_print(text):016x}"
    assert [w for b in simhash.word_blocks(b" a  bb\tccc ", 2) for w in b] == [b"a", b"bb", b"ccc"]


def test_given_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    found = simhash.near_duplicates(df)
    assert found.columns == ["doc_id", "fingerprint", "component_id"]
    assert got(found) == plain_components(rows)
