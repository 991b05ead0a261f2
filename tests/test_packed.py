"""Streams that replay whole logs: rows packed for the state processors, handoffs followed without Python, few partitions."""

import os
import random

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tandem.operators import handoff
from tandem.schemas import ACTIVE, SHADOW
from tandem.session import run_dir
from tandem.streaming import control, drain, packed, runtime
from tests.conftest import rows
from tests.test_control import log
from tests.test_streams import Handle


def frames(*tables):
    return [pd.DataFrame({packed.PACKED: [packed.pack_table(t)]}) for t in tables]


def test_packs_hold_every_row_under_its_key(spark, monkeypatch):
    monkeypatch.setattr(packed, "ROWS_PER_PACK", 50)
    table = spark.range(1000).select(F.when(F.col("id") % 7 > 0, F.concat(F.lit("k"), F.col("id") % 7)).alias("key"), (F.col("id") % 3).cast("int").alias("part"), "id")
    got = [(r.key, r.part, n) for r in packed.pack(table, ["key", "part"]).collect() for n in packed.ints(packed.unpack([pd.DataFrame({packed.PACKED: [bytes(r.packed)]})]), "id")]
    assert sorted(got, key=repr) == sorted(((r.key, r.part, r.id) for r in table.collect()), key=repr)


def test_partition_reader_answers_each_target_as_an_array():
    handle, reader = Handle(), drain.PartitionReader()
    reader.init(handle)
    log_ = pa.table({"at_ms": [5, 1, 3, 4], "kind": [1, 0, 1, 0], "place1": [9, 1, 4, 2], "place2": [0, 0, 0, 0], "offset": [9, 4, 4, 8]})
    (out,) = reader.handleInputRows((1, "a", 0), frames(log_), None)
    assert packed.unpack([out]).select(["at_ms", "partition", "prepared1"]).to_pylist() == [{"at_ms": 3, "partition": 0, "prepared1": 1}, {"at_ms": 5, "partition": 0, "prepared1": 2}]
    assert handle.value == (9, None, None, None)


def test_a_position_without_time_or_offset_reaches_nothing():
    handle, reader = Handle(), drain.PartitionReader()
    reader.init(handle)
    log_ = pa.table({"at_ms": [None, 3], "kind": [1, 0], "place1": [None, 2], "place2": [0, 0], "offset": [None, -8]})
    assert not list(reader.handleInputRows((1, "a", 0), frames(log_), None)) and handle.value == (int(drain._NONE), -8, 2, 0)


def test_a_pending_cutover_goes_over_batches_of_packed_reports():
    handle, pending = Handle(), drain.PendingCutover()
    pending.init(handle)
    signal = pa.table({"at_ms": [1, 9], "kind": [0, 0], "place1": [1, 9], "place2": [0, 0], "trace_id": ["t", "u"], "needs": [2, 1], "partitions": [[0, 1], [0]], "targets": [[5, 6], [7]]})

    def reports(*found):
        at, partition, prepared = zip(*found, strict=True)
        n = len(at)
        return pa.table({"at_ms": at, "kind": [1] * n, "place1": at, "place2": [0] * n, "partition": partition, "prepared1": prepared, "prepared2": [0] * n, "is_report": [1] * n})

    assert not list(pending.handleInputRows((1, "a"), frames(signal.slice(0, 1), reports((2, 0, 1), (3, 0, 1))), None))
    assert handle.value == ("t", 1, 1, 0, [0, 1], [5, 6], [0])
    (out,) = pending.handleInputRows((1, "a"), frames(reports((4, 0, 1), (5, 1, 1), (6, 1, 1), (10, 0, 9)), signal.slice(1, 1)), None)
    assert out[["trace_id", "prepared_ms", "drained_ms", "targets"]].values.tolist() == [["t", 1, 5, [5, 6]], ["u", 9, 10, [7]]]
    assert handle.value is None


def test_modes_are_followed_as_arrays():
    handle, processor = Handle(), control.ModeProcessor()
    processor.init(handle)
    table = pa.table({"timestamp": [30, 10, 20], "place1": [3, 1, 2], "place2": [0, 0, 0], "active": [0, 0, 1], "starts_active": [0, 0, 0]})
    (out,) = processor.handleInputRows(("1", "a"), frames(table), None)
    assert out[["mode", "since_ms"]].values.tolist() == [[ACTIVE, 20], [SHADOW, 30]] and handle.value == (SHADOW,)


def random_signals(seed):
    rng = random.Random(seed)
    kinds = ["TRIGGER", "PREPARE_HANDOFF", "PREPARE_HANDOFF", "DRAINED_AT", "DRAINED_AT", "PROMOTE", "PROMOTED_CONFIRMED", "TRANSFER_REFUSED", "SAVEPOINT_FAILED", "HANDOFF_ABORT", "HEARTBEAT"]
    extra = {"PREPARE_HANDOFF": [None, {}, {0: 1}, {0: 1}], "HANDOFF_ABORT": [None, "", "why"]}
    return [(kind, at, f"t{rng.randrange(60)}", rng.choice(extra.get(kind, [None]))) for at in sorted(rng.sample(range(0, 600_000), 240)) for kind in [rng.choice(kinds)]]


@pytest.mark.parametrize("count", [1, 4])
def test_replayed_progress_equals_the_state_processor(spark, count):
    signals = log(spark, *random_signals(3))
    end, folder = 600_000, run_dir(spark, "test-progress-replay")
    staged = runtime.stage(signals, "offset", f"{folder}/log", count)
    processed = runtime.run_to_table(control.stream_handoff_progress(staged.stream(spark), stored_log=True), f"{folder}/processed")
    want = processed.unionByName(control.timed_out_traces(spark, f"{folder}/processed/checkpoint", end))
    replay = control.ProgressReplay(folder)
    runtime.run_batches(replay.steps(staged.stream(spark)), replay, f"{folder}/checkpoint", "update")
    got = replay.ended(spark, end)
    assert rows(got) == rows(want) and got.columns == want.columns
    outcomes = {(r.state, r.reason, r.assumed) for r in got.collect()}
    assert {("HANDOFF_COMPLETE", None, True), ("HANDOFF_FAILED", "why", False), ("HANDOFF_FAILED", handoff.DRAIN_TIMEOUT, False)} <= outcomes


def test_replays_keep_their_state_in_few_partitions(spark):
    before = spark.conf.get(runtime.PARTITIONS_CONF)
    folder = run_dir(spark, "test-few")
    signals = log(spark, ("PROMOTE", 1, "t", "b"))
    spark.conf.set(runtime.PARTITIONS_CONF, "40")
    try:
        stream = control.stream_modes(runtime.stage(signals, "offset", f"{folder}/log").stream(spark), F.col("app_id") == "a")
        assert runtime.run_to_table(stream, folder).count() == 1
        assert spark.conf.get(runtime.PARTITIONS_CONF) == "40"
    finally:
        spark.conf.set(runtime.PARTITIONS_CONF, before)
    assert len([n for n in os.listdir(f"{folder}/checkpoint/state/0") if n.isdigit()]) == max(8, spark.sparkContext.defaultParallelism)
