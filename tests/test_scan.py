"""Running values against a plain loop, with whole and with split keys."""

import random

import pytest
from pyspark.sql import functions as F

from tandem.operators import scan
from tandem.operators.scan import CHUNK, Running, find_hot_keys, running, with_chunk
from tandem.operators.small import join_small

from tests.conftest import rows

SPECS = [
    ("sum", False), ("sum", True), ("max", False), ("max", True), ("min", True),
    ("last", False), ("last", True), ("lag", False), ("lead", False),
]


def expected(table):
    out = []
    for key in {r[0] for r in table}:
        series = sorted((r for r in table if r[0] == key), key=lambda r: (r[1], r[2]))
        values = [r[3] for r in series]
        for i, row in enumerate(series):
            got = list(row)
            for kind, before in SPECS:
                window = values[: i + (0 if before else 1)]
                known = [v for v in window if v is not None]
                if kind == "lag":
                    got.append(values[i - 1] if i else None)
                elif kind == "lead":
                    got.append(values[i + 1] if i + 1 < len(values) else None)
                elif kind == "last":
                    got.append(known[-1] if known else None)
                else:
                    got.append({"sum": sum, "max": max, "min": min}[kind](known) if known else None)
            out.append(tuple(got))
    return sorted(out, key=repr)


def table(seed):
    rng = random.Random(seed)
    keys = [0] * 300 + [1] * 60 + list(range(2, 20)) * 3 + [None] * 40
    return [(k, rng.randrange(50), n, rng.choice([None, rng.randrange(-9, 10)])) for n, k in enumerate(keys)]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("split", [False, True])
def test_running_values(spark, request, seed, split):
    if split:
        request.getfixturevalue("small_chunks")
    data = table(seed)
    df = spark.createDataFrame(data, "k int, at bigint, n int, v int")
    specs = [Running(f"s{i}", kind, F.col("v"), before) for i, (kind, before) in enumerate(SPECS)]
    hot = find_hot_keys(df, ["k"], "at")
    assert hot.found == split
    got = running(df, ["k"], ["at", "n"], *specs, hot=hot)
    result = sorted((tuple(r[c] for c in ["k", "at", "n", "v"] + [s.name for s in specs]) for r in got.collect()), key=repr)
    assert result == expected(data)


def test_hot_keys_are_the_large_ones(spark, small_chunks):
    df = spark.createDataFrame([(k, n) for k, size in ((7, 100), (8, 21), (9, 20)) for n in range(size)], "k int, at bigint")
    hot = find_hot_keys(df, ["k"], "at")
    assert sorted(r.k for r in hot.levels[0].collect()) == [7, 8]


@pytest.mark.parametrize("buckets", [1, 4, 1 << 18])
def test_sketch_misses_no_hot_key(spark, small_chunks, monkeypatch, buckets):
    """With few counters cold keys share a bucket with hot ones, or fill one together; the exact count sorts them out."""
    monkeypatch.setattr(scan, "SKETCH_BUCKETS", buckets)
    sizes = {None: 50, 0: 21, **{k: k % 20 + 1 for k in range(1, 200)}, 500: 300}
    df = spark.createDataFrame([(k, f"p{k}", n) for k, size in sizes.items() for n in range(size)], "k int, p string, at bigint")
    hot = find_hot_keys(df, ["k", "p"], "at")
    assert sorted((r.k for r in hot.levels[0].collect()), key=repr) == [0, 500, None]


def test_cold_keys_are_not_counted_one_by_one(spark, monkeypatch):
    """Where no bucket is large, the sketch is all that runs."""
    monkeypatch.setattr(scan, "_oversized", None)
    df = spark.range(5000).select((F.col("id") % 700).alias("k"), F.col("id").alias("at"))
    assert not find_hot_keys(df, ["k"], "at").found
    assert not find_hot_keys(df.limit(0), ["k"], "at").found


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_join_small_is_the_same_beyond_the_limit(spark, how):
    big = spark.range(1000).select((F.col("id") % 7).alias("k"), "id")
    small = spark.createDataFrame([(k, f"v{k}") for k in range(5)], "k bigint, v string")
    assert rows(join_small(big, small, ["k"], how, max_rows=3)) == rows(join_small(big, small, ["k"], how))


def test_dense_stretches_are_cut_again(spark, small_chunks):
    """Nearly all rows of the key lie in a hundredth of its range."""
    positions = [0, 10**6] + list(range(5000, 5400))
    df = spark.createDataFrame([(1, p, 1) for p in positions] + [(2, 5, 1)], "k int, at bigint, v int")
    hot = find_hot_keys(df, ["k"], "at")
    assert len(hot.levels) > 1
    sizes = with_chunk(df, hot).groupBy("k", CHUNK).count().collect()
    assert max(r["count"] for r in sizes) <= 20
    got = running(df, ["k"], ["at"], Running("s", "sum", F.col("v")), Running("p", "lag", F.col("at")), hot=hot)
    series = sorted(positions)
    wanted = [(1, p, i + 1, series[i - 1] if i else None) for i, p in enumerate(series)] + [(2, 5, 1, None)]
    assert sorted((r.k, r["at"], r.s, r.p) for r in got.collect()) == wanted


def test_a_scan_has_tasks_by_its_rows(spark):
    """However large a table is, a task sorts a bounded number of its rows, be a key cut or not."""
    table = spark.range(1000).select((F.col("id") % 50).alias("k"), "id")
    spark.conf.set(scan.ROWS_PER_TASK_CONF, "20")
    try:
        for limit in ("20", "1000"):
            spark.conf.set(scan.ROWS_PER_CHUNK_CONF, limit)
            out = scan.running(table, ["k"], ["id"], scan.Running("total", "sum", F.col("id")))
            assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().toString() and "hashpartitioning(k" in out._jdf.queryExecution().toString()
            assert scan.find_hot_keys(table, ["k"], "id").rows == 1000
            assert sorted((r.k, r.id, r.total) for r in out.collect()) == [(k, i, sum(range(k, i + 1, 50))) for k in range(50) for i in range(k, 1000, 50)]
    finally:
        spark.conf.unset(scan.ROWS_PER_TASK_CONF)
        spark.conf.unset(scan.ROWS_PER_CHUNK_CONF)
