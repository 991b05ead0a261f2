"""Near duplicates and repeated strings against brute force."""

import hashlib
import random
import re
import string

import numpy as np
from pyspark.sql import functions as F

from tandem.llm import graph, jaccard_join, suffix_dedup
from tests.llm.conftest import AWKWARD

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def shingle_set(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def brute_components(rows, size, percent):
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, []).append(shingle_set(t, size))
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            for x in sets[a]:
                for y in sets[b]:
                    shared = len(x & y)
                    if shared and 100 * shared >= percent * (len(x) + len(y) - shared):
                        low, high = sorted((find(a), find(b)))
                        parent[high] = low
    return {i: find(i) for i in ids}


def test_awkward_rows_and_empty_table(awkward, nothing):
    got = jaccard_join.near_duplicates(awkward, size=3, percent=90).collect()
    assert len(got) == len(AWKWARD)
    want = brute_components(AWKWARD, 3, 90)
    for r in got:
        assert r["component_id"] == want.get(r["doc_id"])
    sizes = {r["doc_id"]: r["n_shingles"] for r in got}
    assert (sizes[1], sizes[2], sizes[3], sizes[4], sizes[7], sizes[11]) == (0, 0, 0, 1, 8, 1)
    assert jaccard_join.near_duplicates(nothing).count() == 0


def test_near_copies_and_chains_against_brute_force(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdef", k=rng.randint(1, 3))) for _ in range(60)]
    rows, base = [], [rng.choice(words) for _ in range(80)]
    for i in range(150):
        text = list(base) if i % 3 else [rng.choice(words) for _ in range(rng.randint(1, 60))]
        for _ in range(rng.randint(0, 4)):
            text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for size, percent in ((3, 90), (5, 80), (1, 60)):
        got = {r["doc_id"]: r["component_id"] for r in jaccard_join.near_duplicates(docs, size=size, percent=percent).collect()}
        assert got == brute_components(rows, size, percent)
    kept = {r["doc_id"] for r in jaccard_join.one_per_group(docs, size=3, percent=90).collect()}
    assert kept == set(brute_components(rows, 3, 90).values())


def test_components_of_a_long_chain(spark):
    links = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = {r["node"]: r["component"] for r in graph.components(links).collect()}
    assert got == dict.fromkeys(range(61), 0)
    assert graph.components(links.filter("a < 0")).count() == 0

def test_components_extended_by_more_links(spark):
    first = spark.createDataFrame([(1, 2), (5, 4), (9, 8), (20, 21)], "a bigint, b bigint")
    more = spark.createDataFrame([(2, 9), (30, 4), (40, 41), (5, 30), (9, 2)], "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in graph.extend(graph.components(first), more).collect()}
    want = {r["node"]: r["component"] for r in graph.components(first.union(more)).collect()}
    assert got == want == {1: 1, 2: 1, 8: 1, 9: 1, 4: 4, 5: 4, 30: 4, 20: 20, 21: 20, 40: 40, 41: 40}


def brute_repeats(rows, length):
    documents = sorted({(i, t or "") for i, t in rows if i is not None})
    seen, out = set(), {}
    for i, t in documents:
        data, cover = t.encode(), np.zeros(len(t.encode()) + 1, int)
        for at in range(len(data) - length + 1):
            part = data[at : at + length]
            if part in seen:
                cover[at] += 1
                cover[at + length] -= 1
            seen.add(part)
        gone = np.cumsum(cover)[: len(data)] > 0
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[i] = (len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def check_repeats(docs, rows, length):
    got = suffix_dedup.remove_repeats(docs, length=length).collect()
    assert len(got) == len(rows)
    want = brute_repeats(rows, length)
    for r in got:
        if r["doc_id"] is not None:
            assert tuple(r)[1:] == want[r["doc_id"]], r
        else:
            assert r["n_removed"] == 0


def test_repeated_strings_of_awkward_rows(awkward, nothing):
    check_repeats(awkward, AWKWARD, 100)
    assert suffix_dedup.remove_repeats(nothing).count() == 0


def test_repeated_strings_against_brute_force(spark):
    rng = random.Random(5)
    pool = ["".join(rng.choices("abcdé ", k=200)) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(pool)
            at = rng.randrange(150)
            parts += [p[at : at + rng.randint(20, 160)], "".join(rng.choices("xyz", k=rng.randint(0, 50)))]
        rows.append((i, "".join(parts)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for length in (100, 30):
        check_repeats(docs, rows, length)


def test_long_texts_cross_blocks(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup.tx, "BLOCK_BYTES", 1 << 11)
    rng = random.Random(7)
    text = "".join(rng.choices("abcdefgh", k=6000))
    rows = [(1, text), (2, text[500:4000] + "q" + text[1000:]), (3, "r" + text)]
    data, places = suffix_dedup.tx.buffers(__import__("pyarrow").array([t for _, t in rows]))
    runs = [(int(f), int(a), int(b)) for first, lo, hi, _, _, _ in suffix_dedup._runs(data, places, 100, 36) for f, a, b in zip(first, lo, hi)]
    for number, (_, t) in enumerate(rows):
        covered = sorted(p for f, a, b in runs if f == number for p in range(a, b + 1))
        assert covered == list(range(len(t) - 99))
    check_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), rows, 100)
