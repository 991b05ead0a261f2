"""Replays as one stream, in order and in any number of batches; cutovers and drains from signals."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tandem.operators import cutover, handoff
from tandem.schemas import ACTIVE, SHADOW
from tandem.session import run_dir
from tandem.sources import testdata as t
from tandem.sources import topics
from tandem.streaming import control, drain, runtime, sinks
from tests.conftest import rows
from tests.test_control import LOG, log
from tests.test_oracles import connect, plain

SF = "/root/testdata/sf0.001"
STAGED = [
    "state_snapshot_read", "stream_bootstrap", "stream_customer_state", "stream_customer_state_chunked", "stream_cutover", "stream_drained", "stream_handoff_progress",
    "stream_heartbeat_watchdog", "stream_mode", "stream_shadow_pair", "stream_state_digest", "stream_state_evolution", "stream_topic_modes", "stream_topic_progress",
]


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def quoted(name):
    return f'"{name}"'


def batches_of(spark, monkeypatch, count):
    """Every replay takes at least ``count`` batches; gives the queries that ran and their batches."""
    seen, real = [], runtime.stage

    def staged(df, position, folder, batches=1):
        out = real(df, position, folder, max(batches, count))
        seen.append(out)
        return out

    monkeypatch.setattr(runtime, "stage", staged)
    return seen


@pytest.mark.parametrize("name", STAGED)
@pytest.mark.parametrize("count", [5])
def test_results_do_not_depend_on_the_number_of_batches(duck, spark, monkeypatch, name, count):
    seen = batches_of(spark, monkeypatch, count)
    got = entry.queries()[name](spark, SF)
    columns = sorted(got.columns)
    cursor = duck.execute(f"SELECT {', '.join(map(quoted, columns))} FROM ({entry.oracle_sql()[name]})")
    assert sorted(([plain(r[c]) for c in columns] for r in got.collect()), key=repr) == sorted(([plain(v) for v in r] for r in cursor.fetchall()), key=repr)
    assert seen


def test_one_start_takes_all_batches_in_order(spark):
    folder = run_dir(spark, "test-replay")
    seen = []
    staged = runtime.stage(spark.range(1000).select(((F.col("id") * 37) % 1000).alias("seq")), "seq", f"{folder}/topic", 25)
    runtime.run_batches(staged.stream(spark), lambda df, i: seen.append((i, sorted(r["seq"] for r in df.collect()))), f"{folder}/checkpoint")
    assert len(seen) >= 20 and [i for i, _ in seen] == list(range(len(seen)))
    assert [n for _, part in seen for n in part] == list(range(1000))


def test_batches_are_bounded_by_rows(spark):
    spark.conf.set(runtime.ROWS_PER_BATCH_CONF, "100")
    try:
        staged = runtime.stage(spark.range(1000).withColumnRenamed("id", "seq"), "seq", f"{run_dir(spark, 'test-bound')}/topic")
    finally:
        spark.conf.unset(runtime.ROWS_PER_BATCH_CONF)
    sizes = spark.read.parquet(staged.folder).groupBy(F.input_file_name()).count().collect()
    assert len(sizes) >= 9 and max(r["count"] for r in sizes) <= 200


PAIRS = "pair_id int, app1 string, app2 string"


def plain_drained(signals, positions):
    """Row by row in the order of time: what is pending for each copy, and what it has read."""
    timeline = [(at, 0, n, s) for n, (kind, at, trace, *more) in enumerate(signals) for s in [(kind, trace, more[0] if more else None)]]
    timeline += [(at, 1, offset, (app, part, offset)) for app, part, offset, at in positions]
    pending, furthest, out = {}, {}, []

    def check(app, at):
        trace, prepared, offsets = pending[app]
        if all(furthest.get((app, p), float("-inf")) >= o for p, o in offsets.items()):
            out.append((app, trace, prepared, at))
            del pending[app]

    for at, kind, _, row in sorted(timeline, key=lambda r: r[:3]):
        if kind:
            app, part, offset = row
            furthest[app, part] = max(offset, furthest.get((app, part), offset))
            if app in pending:
                check(app, at)
            continue
        name, trace, extra = row
        if name == "PREPARE_HANDOFF" and not extra:
            continue
        for app in ("a", "b"):
            if name == "DEMOTE" and extra != app:
                continue
            pending.pop(app, None)
            if name == "PREPARE_HANDOFF":
                pending[app] = (trace, at, extra)
                check(app, at)
    return sorted(out)


def random_log(seed):
    rng = random.Random(seed)
    signals = []
    for at in sorted(rng.sample(range(0, 400), 60)):
        kind = rng.choice(["PREPARE_HANDOFF", "PREPARE_HANDOFF", "PREPARE_HANDOFF", "HANDOFF_ABORT", "DEMOTE", "HEARTBEAT"])
        extra = {"PREPARE_HANDOFF": rng.choice([None, {}, {0: rng.randrange(90)}, {0: rng.randrange(90), 1: rng.randrange(60), 2: 5}]), "DEMOTE": rng.choice(["a", "b"]), "HANDOFF_ABORT": "why"}.get(kind)
        signals.append((kind, at, f"t{at}", extra))
    positions = [(app, part, rng.randrange(at // 4 + 1), at) for at in range(0, 400, 2) for app in "ab" for part in (0, 1, 2) if rng.random() < 0.3]
    return signals, positions


@pytest.mark.parametrize("seed", range(1))
@pytest.mark.parametrize("count", [1, 12])
def test_drained_equals_row_by_row(spark, seed, count):
    signals, positions = random_log(seed)
    table = spark.createDataFrame([(1, *p) for p in positions], "pair_id int, app_id string, partition int, offset bigint, at_ms bigint")
    pairs = spark.createDataFrame([(1, "a", "b")], PAIRS)
    want = plain_drained(signals, positions)
    assert len(want) > 5
    batch = cutover.drained(cutover.pending_cutovers(log(spark, *signals), pairs), table)
    assert sorted((r.app_id, r.trace_id, r.prepared_ms, r.drained_ms) for r in batch.collect()) == want
    folder = run_dir(spark, "test-drained")
    staged = runtime.stage(drain.union_log(log(spark, *signals), table, pairs), "at_ms", f"{folder}/log", count)
    stream = runtime.run_to_table(drain.stream_drained(staged.stream(spark)), folder)
    assert sorted((r.app_id, r.trace_id, r.prepared_ms, r.drained_ms) for r in stream.collect()) == want


def test_hot_partitions_are_cut(spark, small_chunks):
    signals, positions = random_log(9)
    table = spark.createDataFrame([(1, *p) for p in positions], "pair_id int, app_id string, partition int, offset bigint, at_ms bigint")
    batch = cutover.drained(cutover.pending_cutovers(log(spark, *signals), spark.createDataFrame([(1, "a", "b")], PAIRS)), table)
    assert sorted((r.app_id, r.trace_id, r.prepared_ms, r.drained_ms) for r in batch.collect()) == plain_drained(signals, positions)


def test_a_prepare_without_offsets_is_ignored_everywhere(spark):
    signals = log(spark, ("TRIGGER", 0, "t"), ("PREPARE_HANDOFF", 1, "t", {}), ("PREPARE_HANDOFF", 2, "t"), ("DRAINED_AT", 3, "t", {0: 1}), ("PROMOTED_CONFIRMED", 4, "t"))
    audit = handoff.handoff_outcomes(signals).first()
    assert (audit.state, audit.prepared_ms, audit.triggered_ms) == ("WAITING_FOR_APP2_CATCHUP", None, 0)
    folder = run_dir(spark, "test-empty-prepare")
    ended = runtime.run_to_table(control.stream_handoff_progress(runtime.stage(signals, "offset", f"{folder}/log").stream(spark), stored_log=True), folder)
    assert ended.count() == 0 and control.timed_out_traces(spark, f"{folder}/checkpoint", 10**9).count() == 0
    late = log(spark, ("PREPARE_HANDOFF", 1, "t", {}), ("PREPARE_HANDOFF", 20, "t", {0: 1}), ("DRAINED_AT", 30, "t", {0: 1}), ("PROMOTED_CONFIRMED", 40, "t"))
    assert handoff.handoff_outcomes(late).first().prepared_ms == 20


def test_offsets_in_force_follow_the_signals(spark):
    folder = run_dir(spark, "test-force")
    offsets = sinks.cutovers_from_table(spark, f"{folder}/cutovers")
    batch = spark.createDataFrame([(1, 0, o) for o in range(6)] + [(2, 0, 1)], "pair_id int, partition int, offset bigint")

    def written(side):
        out = []
        sinks.cutover_sink(side, lambda df, i: out.extend((r.pair_id, r.offset) for r in df.collect()), offsets, unsplit="OLD")(batch, 0)
        return sorted(out)

    everything = [(1, o) for o in range(6)] + [(2, 1)]
    assert written("OLD") == everything and written("NEW") == []
    steps = [("PREPARE_HANDOFF", 1, "t", {0: 3}), ("PREPARE_HANDOFF", 2, "u", {}), ("HANDOFF_ABORT", 3, "t"), ("PREPARE_HANDOFF", 4, "v", {0: 1})]
    expected = [[0, 1, 2, 3], [0, 1, 2, 3], list(range(6)), [0, 1]]
    for n, old in enumerate(expected):
        one = log(spark, *steps[: n + 1]).filter(F.col("offset") == n)
        one.write.parquet(f"{folder}/log-{n}")
        stream = drain.stream_cutovers(runtime.stream_table(spark, f"{folder}/log-{n}"))
        runtime.start_to_table(stream, f"{folder}/cutovers", f"{folder}/checkpoint").awaitTermination()
        assert written("OLD") == sorted([(1, o) for o in old] + [(2, 1)])
        assert written("NEW") == [(1, o) for o in range(6) if o not in old]


def test_topic_rows_through_decoding_modes_and_gate(spark):
    """Six topic columns and nothing else: several partitions, junk, broadcasts known by their topic, unknown pairs."""
    pairs = spark.createDataFrame([(1, "a", "b", "control-1"), (2, "c", "d", "control-2")], f"{PAIRS}, topic string")
    signal = '{{"signalType": "{}", "targetAppId": "{}", "timestamp": {}}}'
    rows_ = [
        ("control-1", 0, 5, signal.format("PROMOTE", "b", 50)), ("control-1", 1, 1, signal.format("DEMOTE", "b", 60)), ("control-1", 0, 7, "junk"),
        ("control-1", 0, 9, signal.format("DEMOTE", "a", 55)), ("control-2", 0, 1, signal.format("DEMOTE", "broadcast", 5)), ("other", 0, 1, signal.format("PROMOTE", "x", 1)),
        ("other", 0, 2, signal.format("DEMOTE", "broadcast", 2)), ("other", 0, 3, signal.format("PROMOTE", "d", 70)),
    ]
    schema = "topic string, partition int, offset bigint, timestamp timestamp, key string, value string"
    raw = spark.createDataFrame([(topic, p, o, None, None, v) for topic, p, o, v in rows_], schema)
    folder = run_dir(spark, "test-topic")
    raw.write.parquet(f"{folder}/topic")
    signals = control.with_pair(topics.decode_control_signals(runtime.stream_table(spark, f"{folder}/topic")), pairs)
    stream = control.stream_modes(signals, F.col("app_id").isin("a", "c"), pairs, control.TOPIC_ORDER)
    got = runtime.run_to_table(stream, folder)
    assert rows(got.select("pair_id", "app_id", "mode", "since_ms", "partition", "offset")) == rows(spark.createDataFrame(
        [(1, "b", ACTIVE, 50, 0, 5), (1, "a", SHADOW, 55, 0, 9), (1, "b", SHADOW, 60, 1, 1), (2, "c", SHADOW, 5, 0, 1), (2, "d", ACTIVE, 70, 0, 3)],
        "pair_id int, app_id string, mode string, since_ms bigint, partition bigint, offset bigint",
    ))
    modes = {app: sinks.mode_from_table(spark, f"{folder}/out", SHADOW, control.TOPIC_ORDER)(app) for app in "abcde"}
    assert modes == {"a": SHADOW, "b": SHADOW, "c": SHADOW, "d": ACTIVE, "e": SHADOW}
    counts = sinks.GateCounts(spark, f"{folder}/counts")
    for app in "bd":
        sinks.shadow_sink(app, lambda df, i: None, sinks.mode_from_table(spark, f"{folder}/out", SHADOW, control.TOPIC_ORDER), counts)(spark.range(3), 0)
    assert sorted((r.app_id, r.written, r.dropped) for r in counts.read().collect()) == [("b", 0, 3), ("d", 3, 0)]
    assert t.as_topic(spark.createDataFrame([], f"{LOG}"), "offset").columns == raw.columns
