"""Test items with short questions, and items shorter than a shingle."""

import numpy as np

from tandem.llm import decontaminate

ITEMS = [
    (1, "Why? Because the river freezes over each winter and the ferry stops"), (2, "Define entropy? It counts the states that look alike from outside"),
    (3, "? Nothing but an answer stands here in this odd item"), (4, "Photosynthesis"), (5, "Blue whale"), (6, "?!"),
]


def test_short_questions_and_short_items(spark):
    assert [decontaminate.split_item(t)[1] for _, t in ITEMS[:3]] == ["", "", ""]
    docs = [(i, f"words before it {t} and words after it") for i, t in ITEMS[:3]]
    docs += [(4, "On photosynthesis, and the blue. Whale"), (5, "blue"), (6, "whale blue"), (7, "PHOTOSYNTHESIS"), (8, "whale")]
    got = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1), spark.createDataFrame(ITEMS, "item_id bigint, text string"))
    rows = sorted((r["doc_id"], r["item_id"], r["word"]) for r in got.collect())
    assert [(d, i) for d, i, _ in rows] == [(1, 1), (2, 2), (3, 3), (4, 4), (4, 5), (7, 4)]
    assert rows[3:] == [(4, 4, 1), (4, 5, 4), (7, 4, 0)]


def test_scores_do_not_depend_on_blocks(spark, monkeypatch):
    rng = np.random.Generator(np.random.PCG64(6))
    words = [f"w{i}" for i in range(25)]
    items = [(i, " ".join(rng.choice(words, rng.integers(6, 40)))) for i in range(40)] + [(100, "Blue whale")]
    docs = [(i, f"{' '.join(rng.choice(words, 20))} {' '.join(t.split()[: rng.integers(4, 40)])} end") for i, t in items]
    tables = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = []
    for size in (1 << 24, 1000):
        monkeypatch.setattr(decontaminate, "INDEX_BYTES", size)
        got.append(sorted((r["doc_id"], r["item_id"], round(r["score"], 9)) for r in decontaminate.find_leaks(*tables).collect()))
    assert got[0] == got[1] and len(got[0]) > 20
