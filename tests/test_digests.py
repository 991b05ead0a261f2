"""Digests at agreed offsets against whole states, paths on arrays, readiness over many ticks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandem.operators import chain, fold, lag, verify
from tandem.operators.scan import ROWS_PER_CHUNK_CONF
from tandem.session import run_dir
from tandem.sources import testdata as t
from tandem.streaming import runtime, state
from tests.conftest import rows

SMALL = "/root/testdata/sf0.001"
ORDER = ("offset", "partition")


@pytest.fixture(scope="module")
def events(spark):
    return t.known_business_events(spark, SMALL)


def state_at(events, low, high):
    part = events.filter((F.col("offset") > low) & (F.col("offset") <= high))
    return fold.latest_state(fold.customer_state_changes(part, ORDER), ORDER)


def test_digest_at_an_offset_is_that_of_the_state_there(spark, events, small_chunks):
    top = events.agg(F.max("offset")).first()[0]
    cuts = {f"c{n}": dict.fromkeys(range(24), at) for n, at in enumerate((0, top // 3, top))}
    got = {r["cut"]: (r["states"], r["digest"]) for r in verify.digests_at(verify.digest_steps(fold.customer_state_changes(events, ORDER)), cuts).collect()}
    for name, offsets in cuts.items():
        wanted = verify.table_digest(verify.hash_states(state_at(events, -1, offsets[0]))).first()
        assert got[name] == (wanted["states"], wanted["digest"])


def test_a_copy_started_from_a_snapshot_agrees(spark, events):
    """One copy folds all, the other streams what follows a snapshot; a wrong amount in the snapshot shows."""
    top = events.agg(F.max("offset")).first()[0]
    middle, cuts = top // 2, {"late": dict.fromkeys(range(24), top * 3 // 4), "end": dict.fromkeys(range(24), top)}
    whole = verify.digests_at(verify.digest_steps(fold.customer_state_changes(events, ORDER)), cuts)
    snapshot = state_at(events, -1, middle)
    rest = events.filter(F.col("offset") > middle)
    nothing = fold.customer_state_changes(events.limit(0), ORDER)
    for wrong, agree in ((0, True), (1, False)):
        start = snapshot.withColumn("total_amount", (F.col("total_amount") + wrong).cast("decimal(18,2)"))
        folder = run_dir(spark, "digests")
        topic = runtime.stage(rest, "seq", f"{folder}/topic", 3)
        steps = runtime.run_to_table(state.stream_digest_steps(topic.stream(spark), start), folder)
        assert rows(steps.select("partition", "offset", "step", "states")) == rows(
            verify.digest_steps(fold.customer_state_changes(rest, ORDER, start), initial=start).filter(F.col("offset").isNotNull())
        )
        both = verify.digests_at(steps.unionByName(verify.digest_steps(nothing, initial=start)), cuts)
        assert {r["agree"] for r in verify.digests_agree(whole, both).collect()} == {agree}


def test_no_steps_and_missing_cuts(spark, events):
    none = verify.digest_steps(fold.customer_state_changes(events.limit(0), ORDER))
    got = verify.digests_at(none, {"a": {0: 5}})
    assert [tuple(r) for r in got.collect()] == [("a", 0, None)]
    other = verify.digests_at(none, {"b": {0: 5}})
    assert {(r["cut"], r["agree"]) for r in verify.digests_agree(got, other).collect()} == {("a", False), ("b", False)}
    assert verify.digests_agree(got, got).first()["agree"]


@pytest.mark.parametrize("size", [1, 2, 7, 500])
def test_paths_on_arrays(size):
    rng = random.Random(size)
    for _ in range(20):
        nexts = np.array([rng.choice([-1, *range(at + 1, min(size, at + 4))]) if at + 1 < size else -1 for at in range(size)])
        for start in range(0, size, max(1, size // 9)):
            path = [start]
            while nexts[path[-1]] >= 0:
                path.append(int(nexts[path[-1]]))
            assert sorted(chain._path(nexts, start).tolist()) == path
            assert chain._ends(nexts)[start] == path[-1]


def test_readiness_is_the_same_when_pairs_are_cut(spark):
    rng = random.Random(5)
    table, value = [], 0
    for pair in range(3):
        for tick in range(2000):
            # long stretches, so that some span several chunks
            value = 1 - value if rng.random() < (0.002 if pair else 0.05) else value
            table.append((pair, tick * 5000, value))
    lags = spark.createDataFrame(table, "pair_id int, observed_ms bigint, max_lag bigint")
    whole = rows(lag.ready_times(lags, 60_000))
    spark.conf.set(ROWS_PER_CHUNK_CONF, "100")
    try:
        cut = rows(lag.ready_times(lags, 60_000))
    finally:
        spark.conf.unset(ROWS_PER_CHUNK_CONF)
    assert cut == whole and len(whole) > 5
