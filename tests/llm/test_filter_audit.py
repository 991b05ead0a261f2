"""Filter interactions against plain counting, and the tries by themselves."""

import random
import re
from collections import Counter
from itertools import permutations

import pytest

import __spark_entry__ as entry
from tandem.llm import filter_audit
from tests.llm.conftest import AWKWARD, SF
from tests.test_oracles import compare, connect


def plain_audit(rows, labels):
    """The report of ``(id, text, part)`` rows by counting each document in each order."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    lowest = {}
    for doc, text, _ in rows:
        if doc is not None:
            lowest[text or ""] = min(lowest.get(text or "", doc), doc)
    out, failed = {}, []
    for doc, text, part in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)), "E": doc is not None and lowest[text] < doc,
        }
        failed.append((doc, part or "", {f for f, x in fails.items() if x}))
    shapley = Counter()
    for part in {p for _, p, _ in failed}:
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                c = Counter()
                for doc, own, fails in failed:
                    if own == part:
                        gone = bool(fails & set(order[: step - 1]))
                        c["kept"] += f not in fails and not gone
                        c["removed"] += f in fails and not gone
                        c["redundant"] += f in fails and gone
                        c["unique_fails"] += fails == {f}
                        c["good_lost"] += f in fails and not gone and doc in good
                        c["toxic_lost"] += f in fails and not gone and doc in toxic
                out[part, "".join(order), step] = c
                shapley[part, f] += c["removed"]
    for (part, order, step), c in out.items():
        c["shapley"] = shapley[part, order[step - 1]]
    return out


MEASURES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def check(spark, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = {(r["part"], r["filter_order"], r["step"]): [r[m] for m in MEASURES] for r in filter_audit.audit(docs, marks).collect()}
    assert got == {k: [c[m] for m in MEASURES] for k, c in plain_audit(rows, labels).items()}


def mixed(count, seed):
    rng = random.Random(seed)
    texts = [" ".join(rng.choice(["word", "Word", "a#b", f"w{i}", "XYZ", "x"]) + str(rng.randrange(10**k)) for i in range(rng.choice([5, 150, 250]))) for k in (1, 3, 6) for _ in range(6)]
    texts += ["start " * 60 + t for t in texts[:6]] + [texts[0][:100], texts[0] + " more", "", None]
    return [(rng.choice([None, *range(1, count)]), rng.choice(texts), rng.choice(["en", "de", "", None])) for _ in range(count)]


def test_awkward_rows(spark, nothing):
    rows = [(i, t, "en" if (i or 0) % 2 else None) for i, t in AWKWARD] + [(20, "w " * 60_000, "en")]
    check(spark, rows, [(2, 1, 0), (8, 0, 1), (8, 1, 0), (None, 1, 1), (11, 1, 1), (20, 1, None)])
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert filter_audit.audit(nothing.selectExpr("*", "'en' as lang"), labels).collect() == []


@pytest.mark.parametrize("small", [False, True])
def test_copies_over_many_tasks(spark, monkeypatch, small):
    """With tiny tries and shards, prefixes grow to whole texts and copies meet across tasks."""
    if small:
        monkeypatch.setattr(filter_audit, "TRIE_BYTES", 2000)
        monkeypatch.setattr(filter_audit, "SHARD_BYTES", 3000)
    check(spark, mixed(200, 5), [(i, i % 2, int(i % 3 == 0)) for i in range(1, 60)])


def test_clashing_columns(spark, awkward):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int")
    report = filter_audit.audit(awkward.selectExpr("*", "'x' as lang", "1 as mask", "2 as size", "3 as prefix", "'p' as part", "1 as first"), labels)
    assert report.filter("filter_order = 'ABCDE' and step = 1").selectExpr("kept + removed").first()[0] == len(AWKWARD)


def test_trie_keeps_the_smallest_id_of_each_text():
    rng = random.Random(1)
    rows = [("".join(rng.choice("ab") for _ in range(rng.randrange(12))).encode(), rng.randrange(1000)) for _ in range(3000)]
    rows += [(b"x" * 5000 + bytes([i % 7]), i) for i in range(50)]
    trie, lowest, place = filter_audit.RadixTrie(), {}, {}
    for text, doc in rows:
        assert place.setdefault(text, trie.insert(text, doc)) == trie.insert(text, doc)
        lowest[text] = min(lowest.get(text, doc), doc)
    assert list(trie.terminals()) == sorted(lowest.items())


def test_given_tables_against_sql(spark):
    assert compare(connect(SF), spark, "op13_filter_audit") == 4 * 120 * 5
    assert "op13_filter_audit" in entry.queries()
