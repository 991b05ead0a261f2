"""Rounds of the pair search on small tables: few tasks, and the same groups however the tables are dealt out."""

import random

import pytest
from pyspark.sql import functions as F

from tandem.llm import graph, jaccard_join
from tandem.session import stored
from tests.llm.test_pairs import brute_components

PARTITIONS = 32


@pytest.fixture
def copies():
    """One large group of near copies that chain, and texts of their own with a common passage."""
    rng = random.Random(5)
    base = [f"w{n}" for n in range(60)]
    rows = []
    for i in range(12):
        base = [rng.choice("abcdefgh") + str(i) if rng.random() < 0.03 else w for w in base]
        rows.append((i, " ".join(base)))
    common = " ".join(f"c{n}" for n in range(12))
    return [*rows, *((100 + i, common + " " + " ".join(f"own{rng.randint(0, 40)}" for _ in range(6))) for i in range(6))]


def grouped(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return {r["doc_id"]: r["component_id"] for r in jaccard_join.near_duplicates(df, size=3, percent=80).collect()}


def test_small_rounds_are_not_dealt_out_over_all_partitions(spark, copies):
    context, group = spark.sparkContext, "pair-rounds"
    confs = {"spark.sql.shuffle.partitions": str(PARTITIONS), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {c: spark.conf.get(c) for c in confs}
    for c, v in confs.items():
        spark.conf.set(c, v)
    context.setJobGroup(group, group)
    try:
        got = grouped(spark, copies)
    finally:
        context._jsc.sc().clearJobGroup()
        for c, v in before.items():
            spark.conf.set(c, v)
    assert got == brute_components(copies, 3, 80)
    context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    tracker = context.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    tasks = sum(i.numCompletedTasks for i in map(tracker.getStageInfo, stages) if i)
    print("tasks", tasks)
    assert 0 < tasks < 25 * PARTITIONS


def test_tables_over_the_limits_give_the_same_groups(spark, copies, monkeypatch):
    monkeypatch.setattr(jaccard_join, "PREFIX_PAIRS", 1)
    monkeypatch.setattr(jaccard_join, "SET_PAIRS", 1)
    monkeypatch.setattr(graph, "LINKS_PER_PART", 3)
    monkeypatch.setattr(graph.gathered, "__defaults__", (3,))
    assert grouped(spark, copies) == brute_components(copies, 3, 80)


def test_a_written_table_has_the_partitions_its_rows_ask_for(spark):
    table = stored(spark.range(100).repartition(20), "test-gathered")
    assert graph.gathered(table).rdd.getNumPartitions() == 1
    assert rows_of(graph.gathered(table, 30)) == list(range(100))
    assert graph.gathered(table.filter(F.col("id") < 0).transform(lambda df: stored(df, "test-none"))).count() == 0


def rows_of(df):
    return sorted(r["id"] for r in df.collect())
