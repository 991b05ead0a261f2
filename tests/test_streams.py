"""Streams over files that arrive one after the other, with restarts, late rows and role changes."""

import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tandem.operators import alerts, fold, handoff
from tandem.schemas import ACTIVE, SHADOW
from tandem.session import run_dir
from tandem.sources import testdata as t
from tandem.sources import topics
from tandem.streaming import control, runtime, sinks, state

from tests.conftest import rows, slices

SF = "/root/testdata/sf0.001"
TABLE = (
    "customer_id STRING, order_count INT, total_amount DECIMAL(18,2), last_event_type STRING, last_updated_ms BIGINT, "
    "state_version INT, seq BIGINT"
)


def changes_of(df):
    return rows(df.select(F.col("offset").alias("seq"), "event_id", *fold.STATE_COLUMNS))


@pytest.mark.parametrize("parts", [1, 4])
def test_late_and_unsorted_rows_all_fold_across_restarts(spark, parts):
    folder = run_dir(spark, "test-fold")
    events = t.business_events_ooo(spark, SF)
    for path in slices(events, "seq", f"{folder}/topic", parts):
        changes = state.stream_customer_state(runtime.stream_table(spark, path))
        runtime.start_to_table(changes, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    got = spark.read.parquet(f"{folder}/out")
    expected = fold.customer_state_changes(events)
    assert changes_of(got) == rows(expected)
    assert rows(state.read_snapshot(spark, f"{folder}/checkpoint").select(*fold.STATE_COLUMNS)) == rows(fold.latest_state(expected))


def test_a_checkpoint_goes_on_with_wider_states(spark):
    """Version 1 for a third, then version 2 with a restart in between: no row is lost, old states are upgraded once."""
    folder = run_dir(spark, "test-evolution")
    events = t.known_business_events(spark, SF)
    for number, path in enumerate(slices(events, "seq", f"{folder}/topic", 3)):
        changes = state.stream_customer_state(runtime.stream_table(spark, path), added=(state.PEAK,) if number else ())
        with runtime.evolving_states(spark):
            stream = runtime.start_to_table(changes, f"{folder}/out", f"{folder}/checkpoint")
        stream.awaitTermination()
    got = spark.read.schema(changes.schema).parquet(f"{folder}/out")
    expected = fold.customer_state_changes(events)
    assert rows(got.select("offset", "order_count", "total_amount")) == rows(expected.select(F.col("seq").alias("offset"), "order_count", "total_amount"))

    held, peaks, seen = {}, {}, 0
    for r in got.orderBy("offset").collect():
        key, cents = r["customer_id"], int(r["total_amount"] * 100)
        if r["state_version"] == 2:
            peaks[key] = max(peaks.get(key, held.get(key, 0)), cents)
            assert r["peak_cents"] == peaks[key]
            seen += key in held
        else:
            assert key not in peaks and r["peak_cents"] is None
            held[key] = cents
    assert seen and held
    stored = {r["customer_id"]: (r["state_version"], r["peak_cents"]) for r in state.read_snapshot(spark, f"{folder}/checkpoint").collect()}
    assert stored == {**{k: (1, None) for k in held}, **{k: (2, v) for k, v in peaks.items()}}


def test_the_state_format_holds_for_streams_started_inside_only(spark):
    before = spark.conf.get(runtime.ENCODING_CONF)
    with pytest.raises(RuntimeError), runtime.evolving_states(spark):
        assert spark.conf.get(runtime.ENCODING_CONF) == "avro" != before
        raise RuntimeError
    assert spark.conf.get(runtime.ENCODING_CONF) == before


@pytest.mark.parametrize("version", [1, 2])
def test_wider_states_start_from_a_snapshot_of_either_version(spark, version):
    folder = run_dir(spark, "test-wider-bootstrap")
    event = [("e", "c", "ORDER_CREATED", 5, 0, 9)]
    columns = "event_id string, customer_id string, event_type string, event_ts_ms bigint, partition int, offset bigint"
    spark.createDataFrame(event, columns).withColumn("amount", F.lit(3).cast("decimal(18,2)")).write.parquet(f"{folder}/topic")
    held = "'c' AS customer_id, 1 AS order_count, CAST(7 AS DECIMAL(18,2)) AS total_amount, 'ORDER_CREATED' AS last_event_type, 1L AS last_updated_ms"
    snapshot = spark.sql(f"SELECT {held}, {version} AS state_version" + (", 5000L AS peak_cents" if version == 2 else ""))
    changes = state.stream_customer_state(runtime.stream_table(spark, f"{folder}/topic"), snapshot, (state.PEAK,))
    got = runtime.run_to_table(changes, folder).collect()
    assert [(r["total_amount"], r["state_version"], r["peak_cents"]) for r in got] == [(10, 2, 5000 if version == 2 else 1000)]


def test_bootstrap_continues_a_snapshot(spark):
    folder = run_dir(spark, "test-bootstrap")
    events = t.known_business_events(spark, SF)
    cut = 40
    snapshot = fold.latest_state(fold.customer_state_changes(events.filter(F.col("seq") <= cut)))
    events.filter(F.col("seq") > cut).write.parquet(f"{folder}/topic")
    changes = state.stream_customer_state(runtime.stream_table(spark, f"{folder}/topic"), snapshot)
    got = runtime.run_to_table(changes, folder)
    assert changes_of(got) == rows(fold.customer_state_changes(events).filter(F.col("seq") > cut))


@pytest.mark.parametrize("split", [False, True])
def test_batch_fold_across_batches(spark, request, split):
    if split:
        request.getfixturevalue("small_chunks")
    folder = run_dir(spark, "test-batch-fold")
    events = t.business_events_ooo(spark, SF)
    # full state sets at batches 2 and 4, so later batches start from them
    batches = state.BatchFold(spark, folder, full_every=2)
    for path in slices(events, "seq", f"{folder}/topic", 6):
        runtime.run_batches(runtime.stream_table(spark, path), batches, f"{folder}/checkpoint")
    expected = fold.customer_state_changes(events)
    assert rows(batches.changes()) == rows(expected)
    assert rows(batches.states()) == rows(fold.latest_state(expected))


def test_batch_that_runs_again_changes_nothing(spark):
    folder = run_dir(spark, "test-again")
    events = t.known_business_events(spark, SF).filter("seq < 60")
    batches = state.BatchFold(spark, folder)
    first, second = events.filter("seq < 30"), events.filter("seq >= 30")
    for batch, number in ((first, 0), (second, 1), (second, 1)):
        batches(batch, number)
    assert rows(batches.changes()) == rows(fold.customer_state_changes(events))


def table(spark, folder):
    return sinks.NewerWinsTable(spark, f"{folder}/table", TABLE, "customer_id", "last_updated_ms", "seq")


def write(seq, customer, ts, count):
    return (customer, count, Decimal(1), "ORDER_CREATED", ts, 1, seq)


def test_newer_wins_table(spark):
    folder = run_dir(spark, "test-table")
    sink = table(spark, folder)
    assert sink.read().count() == 0
    rng = random.Random(3)
    writes = [write(n, rng.choice("aab"), rng.randrange(6), n) for n in range(60)]
    stored = {}
    for row in writes:
        if row[0] not in stored or stored[row[0]][4] < row[4]:
            stored[row[0]] = row
    frames = [spark.createDataFrame(writes[i : i + 20], TABLE) for i in (0, 20, 40)]
    # two writers, batches out of order, one of them twice
    sink.writer("app2")(frames[2], 0)
    sink.writer("app1")(frames[0], 0)
    sink.writer("app1")(frames[1], 1)
    sink.writer("app1")(frames[1], 1)
    wanted = sorted(r[:6] for r in stored.values())
    assert sorted(tuple(r) for r in sink.read().collect()) == wanted
    smaller = sink.compact(f"{folder}/compacted")
    assert sorted(tuple(r) for r in smaller.read().collect()) == wanted
    smaller.writer("app1")(spark.createDataFrame([write(99, "a", 100, 7)], TABLE), 2)
    assert smaller.read().filter("customer_id = 'a'").first().order_count == 7


def test_a_new_checkpoint_adds_to_the_table_and_the_counts(spark):
    folder = run_dir(spark, "test-second-checkpoint")
    sink, counts = table(spark, folder), sinks.GateCounts(spark, f"{folder}/counts")
    gate = sinks.shadow_sink("app1", sink.writer("app1"), lambda app: ACTIVE, counts)
    for number, customer in enumerate("ab"):
        spark.createDataFrame([write(number, customer, 5, 1)], TABLE).write.parquet(f"{folder}/topic-{customer}")
        runtime.run_batches(runtime.stream_table(spark, f"{folder}/topic-{customer}"), gate, f"{folder}/checkpoint-{customer}")
    assert sorted(r.customer_id for r in sink.read().collect()) == ["a", "b"]
    assert counts.read().first().written == 2


def test_batches_written_while_compacting_are_kept(spark):
    folder = run_dir(spark, "test-compact")
    sink = table(spark, folder)
    writer = sink.writer("app1")
    for number, customer in enumerate("aab"):
        writer(spark.createDataFrame([write(number, customer, number, number)], TABLE), number)
    survivors = sink._survivors
    # a batch arrives between the listing and the deletion
    sink._survivors = lambda rows: (writer_now(), survivors(rows))[1]

    def writer_now():
        sink._survivors = survivors
        writer(spark.createDataFrame([write(9, "c", 9, 9)], TABLE), 3)

    assert sink.compact() is sink and len(sink._batches()) == 2
    writer(spark.createDataFrame([write(10, "a", 10, 10)], TABLE), 4)
    sink.compact()
    assert len(sink._batches()) == 1
    assert sorted((r.customer_id, r.order_count) for r in sink.read().collect()) == [("a", 10), ("b", 2), ("c", 9)]


def test_a_fold_refuses_the_folder_of_another_checkpoint(spark):
    folder = run_dir(spark, "test-owner")
    events = t.known_business_events(spark, SF).filter("seq < 60")
    events.write.parquet(f"{folder}/topic")
    stream = runtime.stream_table(spark, f"{folder}/topic")
    runtime.run_batches(stream, state.BatchFold(spark, folder), f"{folder}/checkpoint-1")
    before = rows(state.BatchFold(spark, folder).changes())
    with pytest.raises(Exception, match="needs a new folder"):
        runtime.run_batches(stream, state.BatchFold(spark, folder), f"{folder}/checkpoint-2")
    assert rows(state.BatchFold(spark, folder).changes()) == before


def test_a_broken_table_is_not_taken_for_an_empty_one(spark):
    folder = run_dir(spark, "test-broken")
    spark.range(1).write.parquet(f"{folder}/modes")
    with pytest.raises(Exception, match="app_id"):
        sinks.mode_from_table(spark, f"{folder}/modes", SHADOW)("app1")


def test_gate_through_a_handoff(spark):
    """Before: app1 writes 2, app2 drops 1. During: app1 writes 1 more. After: app1 writes none, app2 writes 3."""
    folder = run_dir(spark, "test-gate")
    modes = {"app1": ACTIVE, "app2": SHADOW}
    counts, written = sinks.GateCounts(spark, f"{folder}/counts"), []
    gates = {app: sinks.shadow_sink(app, lambda df, i, app=app: written.extend([app] * df.count()), modes.get, counts) for app in modes}

    def send(app, batch_id, n):
        gates[app](spark.range(n).toDF("id"), batch_id)

    send("app1", 0, 2)
    send("app2", 0, 1)
    send("app1", 1, 1)
    modes.update(app1=SHADOW, app2=ACTIVE)
    send("app1", 2, 3)
    send("app2", 1, 3)
    assert (written.count("app1"), written.count("app2")) == (3, 3)
    assert {r.app_id: (r.written, r.dropped) for r in counts.read().collect()} == {"app1": (3, 3), "app2": (3, 1)}


def test_mode_survives_a_restart(spark):
    folder = run_dir(spark, "test-mode")
    mode = sinks.mode_from_table(spark, f"{folder}/modes", SHADOW)
    assert mode("app2") == SHADOW
    changes = [("app2", ACTIVE, 5, 0), ("app2", SHADOW, 9, 0), ("app2", ACTIVE, 7, 0)]
    spark.createDataFrame(changes, "app_id string, mode string, offset bigint, trace_no bigint").write.parquet(f"{folder}/modes")
    assert mode("app2") == SHADOW and mode("app1") == SHADOW


def test_cutover_writes_each_record_once(spark):
    folder = run_dir(spark, "test-cutover")
    cut = spark.createDataFrame([(1, 0, 4), (1, 1, 2)], "pair_id int, partition int, cutover bigint")
    batch = spark.createDataFrame([(1, p, o) for p in (0, 1, 2) for o in range(8)], "pair_id int, partition int, offset bigint")
    for side in ("OLD", "NEW"):
        sinks.cutover_sink(side, lambda df, i, side=side: df.write.parquet(f"{folder}/{side}"), cut)(batch, 0)
    old, new = spark.read.parquet(f"{folder}/OLD"), spark.read.parquet(f"{folder}/NEW")
    assert sorted((r.partition, r.offset) for r in old.collect()) == [(0, o) for o in range(5)] + [(1, o) for o in range(3)]
    # partition 2 was never agreed on and belongs to neither
    assert old.unionByName(new).filter("partition < 2").distinct().count() == 16 and old.count() + new.count() == 16


def test_signal_handler_sees_every_delivered_signal_once(spark):
    folder = run_dir(spark, "test-handler")
    signals = t.control_signals(spark, SF)
    seen = []
    for path in slices(signals, "offset", f"{folder}/topic", 2):
        stream = topics.encode_control_signals(runtime.stream_table(spark, path))
        runtime.run_batches(stream, lambda df, i: seen.append(df.count()), f"{folder}/checkpoint")
    assert len(seen) == 2 and sum(seen) == signals.count()


def progress(df):
    columns = ["trace_id", "state", "reason", "assumed", "prepared_ms", "drained_ms", "confirmed_ms", "finished_ms"]
    return rows(df.select(*columns))


def test_handoff_progress_across_restarts_equals_the_audit(spark):
    folder = run_dir(spark, "test-progress")
    log = t.control_log(spark, SF)
    # the log arrives in order of time, as a topic does
    for path in slices(log, "offset", f"{folder}/topic", 4):
        stream = control.stream_handoff_progress(runtime.stream_table(spark, path), stored_log=True)
        runtime.start_to_table(stream, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    last = log.agg(F.max("timestamp")).first()[0]
    got = spark.read.schema(stream.schema).parquet(f"{folder}/out").unionByName(control.timed_out_traces(spark, f"{folder}/checkpoint", last))
    assert progress(got) == progress(handoff.handoff_outcomes(log).filter(F.col("finished_ms") <= last))


@pytest.mark.parametrize("parts", [1, 12])
def test_silences_do_not_depend_on_the_number_of_slices(spark, parts):
    folder = run_dir(spark, "test-silences")
    beats, timeout = t.heartbeats(spark, SF), 24 * t.HOUR
    for path in slices(beats, "ts_ms", f"{folder}/topic", parts):
        stream = control.stream_heartbeat_watchdog(runtime.stream_table(spark, path), timeout, stored_log=True)
        runtime.start_to_table(stream, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    ended = spark.read.schema(stream.schema).parquet(f"{folder}/out")
    got = ended.unionByName(control.open_silences(spark, f"{folder}/checkpoint", timeout))
    expected = alerts.heartbeat_gaps(beats, timeout)
    assert rows(got.select(*expected.columns)) == rows(expected)


class Handle:
    """Stands in for the handle and the clock of a state processor."""

    def __init__(self):
        self.value, self.timers, self.now = None, set(), 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)

    def getCurrentProcessingTimeInMs(self):
        return self.now

    def expire(self, processor, key):
        due = {at for at in self.timers if at <= self.now}
        self.timers -= due
        return [r for _ in due for r in processor.handleExpiredTimer(key, self, None)]


def test_a_live_silence_is_reported_again_and_again_whatever_the_clock_of_the_beat():
    handle, watchdog = Handle(), control.HeartbeatWatchdog(1000, live=True)
    watchdog.init(handle)
    handle.now = 10_000
    assert not list(watchdog.handleInputRows(("a",), [Row(ts_ms=14_000)], handle))
    for now in (11_000, 12_500):
        handle.now = now
        (report,) = handle.expire(watchdog, ("a",))
        assert (report.last_beat_ms, report.silence_ms, report.still_open) == (14_000, now - 10_000, True)
    handle.now = 13_000
    list(watchdog.handleInputRows(("a",), [Row(ts_ms=15_000)], handle))
    assert handle.timers == {14_000}


def test_a_live_deadline_is_set_once_per_stage_and_ended_traces_are_forgotten():
    def signal(kind, offset):
        return Row(place1=offset, place2=0, signal_type=kind, timestamp=offset, reason=None, has_offsets=True)

    handle, progress_of = Handle(), control.HandoffProgress(60_000, 30_000, live=True)
    progress_of.init(handle)
    key = (1, "t")
    list(progress_of.handleInputRows(key, [signal("PREPARE_HANDOFF", 1)], handle))
    handle.now = 50_000
    list(progress_of.handleInputRows(key, [signal("OTHER", 2)], handle))
    assert handle.timers == {60_000}
    handle.now = 60_000
    (report,) = handle.expire(progress_of, key)
    assert (report.state, report.reason, report.finished_ms) == ("HANDOFF_FAILED", handoff.DRAIN_TIMEOUT, 60_001)
    handle.now += control.KEEP_ENDED_MS
    assert handle.expire(progress_of, key) == [] and handle.value is None and not handle.timers


def test_modes_across_restarts(spark):
    folder = run_dir(spark, "test-modes")
    signals = t.control_signals(spark, SF)
    for path in slices(signals, "offset", f"{folder}/topic", 3):
        stream = control.stream_modes(runtime.stream_table(spark, path), F.col("app_id").startswith("app1-"))
        runtime.start_to_table(stream, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    from tandem.operators import modes

    timeline = modes.mode_timeline(t.control_signals(spark, SF), t.pairs(spark, SF)).filter("valid_from_ms > 0")
    got = spark.read.parquet(f"{folder}/out").select("app_id", "mode", F.col("since_ms").alias("valid_from_ms"))
    assert rows(got) == rows(timeline.select("app_id", "mode", "valid_from_ms"))


def test_start_positions():
    assert topics.topic_positions("business-events", {1: 7, 0: 5}) == '{"business-events": {"0": 5, "1": 7}}'


def test_floored_sums_equal_single_steps():
    rng = random.Random(4)
    for _ in range(200):
        start, steps = rng.randrange(20), [(rng.randrange(-9, 10), rng.random() < 0.6) for _ in range(rng.randrange(1, 30))]
        steps = [(d if floored else abs(d), floored) for d, floored in steps]
        want, value = [], start
        for d, floored in steps:
            value = max(0, value + d) if floored else value + d
            want.append(value)
        assert state.floored_sums(start, np.array([d for d, _ in steps]), np.array([f for _, f in steps])).tolist() == want
