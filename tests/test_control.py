"""Signals, modes, handoffs and locks on small hand-made logs."""

import random

import pytest
from pyspark.sql import functions as F

from tandem.config import StandbyConfig
from tandem.operators import alerts, handoff, lag, leases, modes, savepoints
from tandem.sources import topics

LOG = (
    "pair_id int, offset bigint, trace_no bigint, signal_type string, target_app_id string, source_app_id string, "
    "cutover_offsets map<int,bigint>, coordinator_id string, timestamp bigint, trace_id string, reason string"
)


def log(spark, *signals):
    """(type, time, trace[, reason or offsets or target]) in log order."""
    out = []
    for n, (kind, at, trace, *more) in enumerate(signals):
        extra = more[0] if more else None
        out.append((
            1, n, 0, kind, extra if kind in ("PROMOTE", "DEMOTE") else "broadcast", "c", extra if isinstance(extra, dict) else None,
            "c", at, trace, extra if kind == "HANDOFF_ABORT" else None,
        ))
    return spark.createDataFrame(out, LOG)


def test_business_json_round_trip(spark):
    raw = spark.createDataFrame(
        [('{"eventId":"evt-001","customerId":"cust-123","eventType":"ORDER_CREATED","amount":99.99,"eventTimestamp":1711700000000,'
          '"payload":"{\\"orderId\\":\\"ord-456\\"}","more":1}',), ('{"eventId":"evt-002","customerId":"cust-123","eventType":"ORDER_UPDATED"}',)],
        "value string",
    )
    first, second = topics.decode_business_events(raw).collect()
    assert (first.event_id, str(first.amount), first.event_ts_ms, first.payload) == ("evt-001", "99.99", 1711700000000, '{"orderId":"ord-456"}')
    assert (str(second.amount), second.event_ts_ms) == ("0.00", 0)


@pytest.mark.parametrize("value", ["not-json", "", None])
def test_malformed_business_record_fails_the_job(spark, value):
    with pytest.raises(Exception, match="MALFORMED_RECORD|empty business record"):
        topics.decode_business_events(spark.createDataFrame([(value,)], "value string")).collect()


@pytest.mark.parametrize("kind,offsets,reason", [
    ("PREPARE_HANDOFF", {0: 5000, 1: 4998, 23: 5100}, None), ("DRAINED_AT", {0: 6000, 1: 5999}, None), ("PROMOTE", None, None),
    ("HANDOFF_ABORT", None, "drain timeout"),
])
def test_control_json_round_trip(spark, kind, offsets, reason):
    signal = spark.createDataFrame([(1, 2, 0, kind, "app2", "c", offsets, "c", 17, "t1", reason)], LOG)
    encoded = topics.encode_control_signals(signal)
    assert encoded.first().key == "app2" and "null" not in encoded.first().value
    assert topics.decode_control_signals(encoded.drop("key")).select(*signal.columns).first() == signal.first()


def test_unreadable_control_records_are_skipped(spark):
    bad = ["not-json", "", None, '{"signalType":"REBOOT"}', '{"signalType":"HEARTBEAT","timestamp":"x"}', '{"signalType":"PROMOTE","cutoverOffsets":{"a":1}}', "{}", "[]"]
    raw = spark.createDataFrame([(v,) for v in [*bad, '{"signalType":"HEARTBEAT","new":true}']], "value string")
    assert topics.unreadable_records(raw).first().skipped == len(bad)
    assert [r.signal_type for r in topics.decode_control_signals(raw).collect()] == ["HEARTBEAT"]


def test_modes_follow_only_promote_and_demote(spark):
    pairs = spark.createDataFrame([(1, "app1", "app2")], "pair_id int, app1 string, app2 string")
    signals = log(
        spark, ("PREPARE_HANDOFF", 10, "t1", {0: 1}), ("PROMOTE", 20, "t1", "app2"), ("HEARTBEAT", 25, None), ("DEMOTE", 30, "t1", "app1"),
        ("HANDOFF_ABORT", 40, "t1", "x"), ("PROMOTE", 50, "t2", "app2"), ("DEMOTE", 60, "t2", "app2"),
    )
    timeline = modes.mode_timeline(signals, pairs).orderBy("app_id", "valid_from_ms").collect()
    assert [tuple(r)[1:] for r in timeline] == [
        ("app1", "ACTIVE", 0, 30), ("app1", "SHADOW", 30, None),
        ("app2", "SHADOW", 0, 20), ("app2", "ACTIVE", 20, 60), ("app2", "SHADOW", 60, None),
    ]
    assert [tuple(r) for r in modes.split_brain_intervals(signals, pairs).collect()] == [(1, 20, 30)]
    # the signal at the very instant of a record counts
    records = spark.createDataFrame([(1, 1, "k", 19), (1, 2, "k", 20), (1, 3, "k", 30), (1, 4, "k", 61)], "pair_id int, seq bigint, customer_id string, ts bigint")
    found = modes.modes_at_write(records, signals, pairs, "ts", "seq")
    writers = {r.seq: (r.app1_mode == "ACTIVE") + (r.app2_mode == "ACTIVE") for r in found.collect()}
    assert writers == {1: 1, 2: 2, 3: 1, 4: 0}
    coverage = {r.seq: (r.status, r.repaired_by) for r in modes.handoff_coverage(found, "customer_id", "seq").collect()}
    assert coverage == {2: ("OVERLAP", None), 4: ("GAP", None)}


def test_addressing(spark):
    pairs = spark.createDataFrame([(1, "app1", "app2")], "pair_id int, app1 string, app2 string")
    signals = log(spark, ("PROMOTE", 1, "t", "app2"), ("PROMOTE", 2, "t", "other"), ("HEARTBEAT", 3, None))
    got = sorted((r.offset, r.app_id) for r in modes.signals_delivered(signals, pairs).collect())
    assert got == [(0, "app2"), (2, "app1"), (2, "app2")]


def test_signals_of_another_trace_are_ignored(spark):
    signals = log(
        spark, ("DRAINED_AT", 0, "early"), ("TRIGGER", 1, "correct-trace"), ("DRAINED_AT", 2, "WRONG-trace"), ("HEARTBEAT", 3, "WRONG-trace"),
        ("DRAINED_AT", 4, None), ("DRAINED_AT", 5, "correct-trace"),
    )
    assert sorted(r.offset for r in modes.signals_for_trace(signals).collect()) == [0, 1, 3, 4, 5]


START = ("TRIGGER", 0, "t")
PREPARE = ("PREPARE_HANDOFF", 1000, "t", {0: 5})
DRAIN = ("DRAINED_AT", 2000, "t", {0: 5})
HANDOFFS = {
    "complete": ([START, PREPARE, DRAIN, ("PROMOTED_CONFIRMED", 2700, "t")], ("HANDOFF_COMPLETE", None, False, 2700)),
    "never confirmed": ([START, PREPARE, DRAIN], ("HANDOFF_COMPLETE", None, True, 32000)),
    "confirmed too late": ([START, PREPARE, DRAIN, ("PROMOTED_CONFIRMED", 32001, "t")], ("HANDOFF_COMPLETE", None, True, 32000)),
    "confirmed without drain": ([START, PREPARE, ("PROMOTED_CONFIRMED", 1500, "t")], ("HANDOFF_FAILED", handoff.DRAIN_TIMEOUT, False, 61000)),
    "drained too late": ([START, PREPARE, ("DRAINED_AT", 61001, "t")], ("HANDOFF_FAILED", handoff.DRAIN_TIMEOUT, False, 61000)),
    "drained before prepare": ([START, ("DRAINED_AT", 500, "t"), PREPARE], ("HANDOFF_FAILED", handoff.DRAIN_TIMEOUT, False, 61000)),
    "drained twice": ([START, PREPARE, DRAIN, ("DRAINED_AT", 2500, "t"), ("PROMOTED_CONFIRMED", 2700, "t")], ("HANDOFF_COMPLETE", None, False, 2700)),
    "aborted while draining": ([START, PREPARE, ("HANDOFF_ABORT", 1500, "t", "manual"), DRAIN], ("HANDOFF_FAILED", "manual", False, 1500)),
    "aborted while promoting": ([START, PREPARE, DRAIN, ("HANDOFF_ABORT", 2500, "t", "manual")], ("HANDOFF_FAILED", "manual", False, 2500)),
    "aborted after completion": (
        [START, PREPARE, DRAIN, ("PROMOTED_CONFIRMED", 2700, "t"), ("HANDOFF_ABORT", 2800, "t", "late")], ("HANDOFF_COMPLETE", None, False, 2700)),
    "aborted at once": ([START, ("HANDOFF_ABORT", 10, "t", "manual")], ("HANDOFF_FAILED", "manual", False, 10)),
    "savepoint failed": ([START, ("SAVEPOINT_FAILED", 10, "t")], ("HANDOFF_FAILED", handoff.SAVEPOINT_FAILED, False, 10)),
    "transfer refused": ([START, PREPARE, DRAIN, ("TRANSFER_REFUSED", 2100, "t")], ("HANDOFF_FAILED", handoff.TRANSFER_REFUSED, False, 2100)),
    "other trace": ([START, PREPARE, DRAIN, ("PROMOTED_CONFIRMED", 2700, "x")], ("HANDOFF_COMPLETE", None, True, 32000)),
    "triggered only": ([START], ("WAITING_FOR_APP2_CATCHUP", None, False, None)),
}


@pytest.mark.parametrize("name", HANDOFFS)
def test_handoff_outcome(spark, name):
    signals, wanted = HANDOFFS[name]
    row = handoff.handoff_outcomes(log(spark, *signals)).filter("trace_id = 't'").first()
    assert (row.state, row.reason, row.assumed, row.finished_ms) == wanted


def test_drain_verification(spark):
    signals = log(
        spark, ("PREPARE_HANDOFF", 0, "short", {0: 5, 1: 7}), ("DRAINED_AT", 1, "short", {0: 6}), ("PREPARE_HANDOFF", 2, "met", {0: 5}),
        ("DRAINED_AT", 3, "met", {0: 5, 9: 1}), ("PREPARE_HANDOFF", 4, "silent", {0: 5}), ("PREPARE_HANDOFF", 5, "empty", {}),
    )
    got = {r.trace_id: (r.drained_ok, r.reported, r.partitions_short) for r in handoff.drain_verification(signals).collect()}
    assert got == {"short": (False, True, 1), "met": (True, True, 0), "silent": (False, False, 1)}


def snapshots(spark, *rows):
    return spark.createDataFrame(
        [(1, g, "t", p, o, at) for g, p, o, at in rows], "pair_id int, group_id string, topic string, partition int, offset bigint, observed_ms bigint"
    )


def test_lag_and_readiness(spark):
    table = snapshots(
        spark, ("app1", 0, 10, 0), ("app2", 0, 4, 0), ("app2", 9, 1, 0), ("app1", 1, 3, 0), ("app1", 0, 10, 5000), ("app2", 0, 12, 5000),
        ("app1", 0, 10, 10000), ("app1", 0, 12, 15000), ("app2", 0, 12, 15000), ("app1", 0, 12, 16000), ("app2", 0, 12, 16000),
        ("app1", 0, 13, 20000), ("app2", 0, 12, 20000), ("app1", 0, 13, 21000), ("app2", 0, 13, 21000),
    )
    lags = lag.partition_lag(table, "t")
    assert sorted((r.observed_ms, r.partition, r.lag) for r in lags.collect())[:2] == [(0, 0, 6), (0, 1, 3)]
    worst = lag.max_lag(lags)
    # the tick without offsets of the second copy is unknown, neither ready nor behind
    assert sorted((r.observed_ms, r.max_lag) for r in worst.collect()) == [(0, 6), (5000, 0), (15000, 0), (16000, 0), (20000, 1), (21000, 0)]
    assert [tuple(r) for r in lag.ready_times(worst, 10000).collect()] == [(1, 5000, 15000)]


def test_heartbeat_silence(spark):
    beats = spark.createDataFrame([("a", t, n) for n, t in enumerate([0, 10, 50, 81])] + [("b", 0, 9)], "app_id string, ts_ms bigint, seq bigint")
    got = sorted(tuple(r) for r in alerts.heartbeat_gaps(beats, 30).collect())
    assert got == [("a", 10, 50, 40, False), ("a", 50, 81, 31, False), ("b", 0, None, 81, True)]


@pytest.mark.parametrize("split", [False, True])
@pytest.mark.parametrize("seed", [1, 2])
def test_transfers_equal_single_writes(spark, request, seed, split):
    if split:
        request.getfixturevalue("small_chunks")
    rng = random.Random(seed)
    attempts, state, wanted = [], {1: ("a", 1), 2: ("b", 5)}, {}
    for seq in range(300):
        pair = rng.choice([1, 1, 1, 2])
        leader, version = state[pair]
        origin, target = rng.choice([("a", "b"), ("b", "a"), ("a", "a")])
        expected = version + rng.choice([0, 0, 1, -1])
        attempts.append((pair, origin, target, expected, seq))
        wanted[seq] = origin == leader and expected == version
        if wanted[seq]:
            state[pair] = (target, version + 1)
    df = spark.createDataFrame(attempts, "pair_id int, from_app string, to_app string, expected_version bigint, seq bigint")
    leaders = spark.createDataFrame([(1, "a", 1), (2, "b", 5)], "pair_id int, app string, version int")
    got = leases.leader_transfers(df, leaders)
    assert {r.seq: r.accepted for r in got.collect()} == wanted
    assert {r.pair_id: (r.leader, r.version) for r in leases.current_leaders(got, leaders).collect()} == state


def lease_steps(ops):
    held, out = {}, {}
    for lock, who, op, at, seq in ops:
        holder, ttl = held.get(lock, (None, None))
        ok = (holder is None or ttl < at) if op == "ACQUIRE" else holder == who
        if ok:
            held[lock] = (None, None) if op == "RELEASE" else (who, at + 30)
        out[seq] = ok
    return out


@pytest.mark.parametrize("split", [False, True])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_leases_equal_single_operations(spark, request, seed, split):
    if split:
        request.getfixturevalue("small_chunks")
    rng = random.Random(seed)
    ops, at = [], 0
    for seq in range(300):
        at += rng.choice([0, 0, 1, 10, 15, 30, 31])
        ops.append((rng.choice([1, 1, 1, 2]), rng.choice("xyz"), rng.choice(["ACQUIRE", "ACQUIRE", "RENEW", "RELEASE"]), at, seq))
    df = spark.createDataFrame(ops, "lock_id int, coordinator_id string, op string, at_s bigint, seq bigint")
    got = leases.lease_replay(df)
    assert {r.seq: r.accepted for r in got.collect()} == lease_steps(ops)


def test_lease_rules(spark):
    def replay(*ops):
        df = spark.createDataFrame([(1, w, op, at, n) for n, (w, op, at) in enumerate(ops)], "lock_id int, coordinator_id string, op string, at_s bigint, seq bigint")
        return leases.lease_replay(df)

    accepted = [r.accepted for r in replay(
        ("x", "ACQUIRE", 0), ("x", "ACQUIRE", 5), ("y", "ACQUIRE", 30), ("x", "RENEW", 40), ("y", "RENEW", 41), ("y", "RELEASE", 42),
        ("x", "RELEASE", 50), ("x", "RENEW", 51), ("y", "ACQUIRE", 52),
    ).orderBy("seq").collect()]
    # own second acquire fails; at the second of expiry nobody can acquire; an expired lease not taken can be renewed
    assert accepted == [True, False, False, True, False, False, True, False, True]
    spans = leases.lease_intervals(replay(("x", "ACQUIRE", 0), ("x", "RENEW", 20), ("y", "ACQUIRE", 51), ("y", "RELEASE", 60)))
    assert sorted(tuple(r) for r in spans.collect()) == [(1, "x", 0, 50, 1, "EXPIRED"), (1, "y", 51, 60, 0, "RELEASED")]
    assert leases.lock_holders(spans, 50).count() == 0
    assert leases.lock_holders(spans, 49).first().holder == "x"


def test_savepoint_register(spark):
    columns = "savepoint_id string, source_job_id string, location string, taken_at_ms bigint, kafka_offsets map<int,bigint>, status string, savepoint_no bigint"
    # the newest completed one lies behind more than five newer failures
    data = [(f"s{n}", "job", f"l{n}", n, {0: n}, "COMPLETED" if n == 1 else "FAILED", n) for n in range(9)]
    best = savepoints.latest_completed(spark.createDataFrame(data, columns)).first()
    assert (best.savepoint_id, best.kafka_offsets) == ("s1", {0: 1})


def test_migration_chain(spark):
    steps = savepoints.Migrations()
    steps.step(1, 2)(lambda df: df.withColumn("tier_level", F.lit("STANDARD")))
    steps.step(2, 3)(lambda df: df.withColumn("tier_level", F.upper("tier_level")))
    states = spark.createDataFrame([("a", 1, None), ("b", 2, "gold"), ("c", 3, "kept")], "customer_id string, state_version int, tier_level string")
    got = {r.customer_id: (r.state_version, r.tier_level) for r in steps.migrate(states, 3).collect()}
    assert got == {"a": (3, "STANDARD"), "b": (3, "GOLD"), "c": (3, "kept")}
    with pytest.raises(ValueError):
        steps.migrate(states, 4)
    with pytest.raises(Exception, match="out of range"):
        steps.migrate(states.withColumn("state_version", F.lit(7)), 3).collect()


def test_config():
    config = StandbyConfig("app2", "b:1").validate()
    assert (config.initial_mode, config.heartbeat_timeout_ms, config.heartbeat_interval_ms, config.group) == ("SHADOW", 30000, 5000, "control-app2")
    for wrong in ({"app_id": " "}, {"brokers": ""}, {"heartbeat_timeout_ms": 0}, {"heartbeat_interval_ms": 30000}, {"initial_mode": "IDLE"}):
        with pytest.raises(ValueError):
            StandbyConfig(**{"app_id": "app1", "brokers": "b:1", **wrong}).validate()
    env = {"STANDBY_APP_ID": "app1", "STANDBY_BROKERS": "b:1", "STANDBY_INITIAL_MODE": "active"}
    assert StandbyConfig.from_env(env).initial_mode == "ACTIVE"
