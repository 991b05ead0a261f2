"""Recall of the permutation index where its candidates are really filtered."""

import numpy as np
from pyspark.sql import functions as F

from tandem.llm import permutation_index as pi


def vectors(count):
    x = np.random.Generator(np.random.PCG64(4)).standard_normal((count, 64))
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def test_one_share_is_reranked_at_every_size():
    for count in (400, 2000, pi.SEGMENT_ROWS):
        x = vectors(count)
        near = np.argsort(-(x @ x[: pi.PIVOTS].T), axis=1, kind="stable")[:, : pi.PREFIX]
        segment = pi._Segment(np.arange(count), x, near, pi.PIVOTS)
        hits, asked = 0, range(0, count, count // 50)
        for q in asked:
            assert len(segment.candidates(near[q], 5)) == int(np.ceil(pi.RERANKED * count))
            scores = x @ x[q]
            scores[q] = -9
            hits += len(set(np.argsort(-scores)[:5]) & set(segment.nearest(q, x[q], near[q], 5)[0]))
        assert hits / (5 * len(asked)) >= 0.9, count


def test_results_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(pi, "SEGMENT_ROWS", 300)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors(1000))]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = [sorted(map(tuple, pi.nearest(table.repartition(n), F.col("vec_id") % 50 == 0).collect())) for n in (1, 7)]
    assert got[0] == got[1] and len(got[0]) == 100


def test_very_large_and_small_components_take_part(spark):
    """Scaling a vector changes neither its neighbours nor a score."""
    x = vectors(200)
    plain = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    scales = [2.0**500, 2.0**-500, 1.0, 2.0**-1000]
    wild = spark.createDataFrame([(i, (v * scales[i % 4]).tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = [sorted(map(tuple, pi.nearest(t, F.col("vec_id") % 50 == 0).collect())) for t in (plain, wild)]
    assert len(got[0]) == 20
    assert [r[:2] for r in got[0]] == [r[:2] for r in got[1]]
    assert np.allclose([r[3] for r in got[0]], [r[3] for r in got[1]], atol=1e-12)
