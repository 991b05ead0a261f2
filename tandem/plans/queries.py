"""The registered queries: each reads whole tables under ``sf_dir`` and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem import schemas
from tandem.functions import scalars
from tandem.operators import (
    alerts, cutover, fold, handoff, lag, leases, metrics, modes, savepoints, status, upsert, verify,
)
from tandem.session import stored
from tandem.sources import testdata as t
from tandem.sources import topics

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# -- fold and conditional write


@query
def customer_state_changes(spark, sf_dir):
    return fold.customer_state_changes(t.known_business_events(spark, sf_dir))


@query
def customer_state_changes_ooo(spark, sf_dir):
    return fold.customer_state_changes(t.business_events_ooo(spark, sf_dir))


@query
def customer_state_latest(spark, sf_dir):
    return fold.latest_state(customer_state_changes(spark, sf_dir))


@query
def unknown_event_types(spark, sf_dir):
    return fold.unknown_event_types(t.business_events(spark, sf_dir))


@query
def key_partitions(spark, sf_dir):
    return fold.key_partitions(t.business_events(spark, sf_dir))


def _upsert(events: DataFrame) -> DataFrame:
    writes = fold.customer_state_changes(events).select("seq", *fold.STATE_COLUMNS)
    return upsert.conditional_upsert(writes, "customer_id", "last_updated_ms", ["seq"]).select(*fold.STATE_COLUMNS)


@query
def conditional_upsert(spark, sf_dir):
    return _upsert(t.business_events_ooo(spark, sf_dir))


@query
def conditional_upsert_ties(spark, sf_dir):
    return _upsert(t.business_events_coarse(spark, sf_dir))


def _audit(events: DataFrame) -> DataFrame:
    # the version written for an event is its event time, so the audit needs no folded value
    writes = fold.known_events(events).select("seq", "customer_id", F.col("event_ts_ms").alias("last_updated_ms"))
    return upsert.conditional_write_audit(writes, "customer_id", "last_updated_ms", ["seq"])


@query
def conditional_write_audit(spark, sf_dir):
    return _audit(t.business_events_ooo(spark, sf_dir))


@query
def conditional_write_audit_ties(spark, sf_dir):
    return _audit(t.business_events_coarse(spark, sf_dir))


# -- topics


@query
def decode_business_events(spark, sf_dir):
    return topics.decode_business_events(t.raw_business_json(spark, sf_dir))


@query
def encode_control_signals(spark, sf_dir):
    return topics.encode_control_signals(t.control_signals(spark, sf_dir))


def _flat(signals: DataFrame) -> DataFrame:
    """Maps as text, which both engines compare alike."""
    return signals.withColumn("cutover_offsets", scalars.offsets_text(F.col("cutover_offsets")))


@query
def decode_control_signals(spark, sf_dir):
    return _flat(topics.decode_control_signals(t.raw_control_json(spark, sf_dir)))


@query
def unreadable_control_records(spark, sf_dir):
    return topics.unreadable_records(t.raw_control_json(spark, sf_dir))


# -- modes, gate and handoff audits


@query
def signals_delivered(spark, sf_dir):
    delivered = modes.signals_delivered(t.control_signals(spark, sf_dir), t.pairs(spark, sf_dir))
    return delivered.select("pair_id", *modes.POSITION, "app_id", "signal_type", "target_app_id", "trace_id")


@query
def signals_for_trace(spark, sf_dir):
    kept = modes.signals_for_trace(t.control_log(spark, sf_dir))
    return kept.select("pair_id", *modes.POSITION, "signal_type", "trace_id", "active_trace")


@query
def mode_timeline(spark, sf_dir):
    return modes.mode_timeline(t.control_signals(spark, sf_dir), t.pairs(spark, sf_dir))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records both copies of a pair would write."""
    return t.known_business_events(spark, sf_dir).select("pair_id", "seq", "event_id", "customer_id", "event_ts_ms")


def _writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those records with the modes in force."""
    records = _records(spark, sf_dir)
    return modes.modes_at_write(records, t.control_signals(spark, sf_dir), t.pairs(spark, sf_dir), "event_ts_ms", "seq")


@query
def write_mode_asof(spark, sf_dir):
    rows = modes.per_app(_writes(spark, sf_dir), t.pairs(spark, sf_dir))
    return rows.select("pair_id", "app_id", "seq", "event_id", "mode")


@query
def shadow_gate_counts(spark, sf_dir):
    return modes.gate_counts(modes.per_app(_writes(spark, sf_dir).select("pair_id", "app1_mode", "app2_mode"), t.pairs(spark, sf_dir)))


@query
def handoff_coverage(spark, sf_dir):
    hot = modes.hot_writers(_records(spark, sf_dir), "customer_id", "seq")
    return modes.handoff_coverage(_writes(spark, sf_dir), "customer_id", "seq", hot).drop("event_ts_ms")


@query
def split_brain_intervals(spark, sf_dir):
    return modes.split_brain_intervals(t.control_signals(spark, sf_dir), t.pairs(spark, sf_dir))


def _cutover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What app1 had committed in the middle of January, without the last two partitions."""
    committed = lag.committed_offsets(t.offset_snapshots(spark, sf_dir), "app1", t.TOPIC)
    middle = committed.filter((F.col("observed_ms") == t.JANUARY + t.TICK * 62) & (F.col("partition") < t.PARTITIONS - 2))
    return cutover.cutover_from_committed(middle)


@query
def cutover_split(spark, sf_dir):
    records = t.business_events(spark, sf_dir).select("event_id", "pair_id", "partition", "offset")
    return cutover.cutover_split(records, _cutover(spark, sf_dir))


# -- offsets and lag


@query
def committed_offsets(spark, sf_dir):
    return lag.committed_offsets(t.offset_snapshots(spark, sf_dir), "app2", t.TOPIC)


@query
def offsets_from_metrics(spark, sf_dir):
    return lag.offsets_from_metrics(t.job_metrics(spark, sf_dir))


@query
def partition_lag(spark, sf_dir):
    return lag.partition_lag(t.offset_snapshots(spark, sf_dir), t.TOPIC)


@query
def max_lag(spark, sf_dir):
    return lag.max_lag(partition_lag(spark, sf_dir))


STABLE_MS = 12 * t.HOUR


@query
def app2_ready_times(spark, sf_dir):
    return lag.ready_times(stored(max_lag(spark, sf_dir), "max_lag"), STABLE_MS)


@query
def worst_partitions(spark, sf_dir):
    return lag.worst_partitions(partition_lag(spark, sf_dir), 3)


@query
def retention_gap(spark, sf_dir):
    saved = lag.committed_offsets(t.offset_snapshots(spark, sf_dir), "app1", t.TOPIC)
    return lag.retention_gap(saved, t.earliest_retained(spark, sf_dir, t.JANUARY + t.TICK * 60))


# -- handoffs and alerts


@query
def handoff_outcomes(spark, sf_dir):
    return handoff.handoff_outcomes(t.control_log(spark, sf_dir))


@query
def handoff_duration(spark, sf_dir):
    return handoff.handoff_durations(handoff_outcomes(spark, sf_dir))


@query
def drain_verification(spark, sf_dir):
    return handoff.drain_verification(t.control_signals(spark, sf_dir))


@query
def heartbeat_gaps(spark, sf_dir):
    return alerts.heartbeat_gaps(t.heartbeats(spark, sf_dir), 24 * t.HOUR)


ALERT_RULES = [
    ("lag-high", "App2ConsumerLagMessages", ">", 0.0, 43200),
    ("standby-writes", "SinkMode", "=", 1.0, 86400),
    ("handoff-slow", "HandoffDurationMs", ">", 10000.0, 3600),
]


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric samples: lag per tick, mode after each mode signal, duration of each completed handoff."""
    lags = max_lag(spark, sf_dir).select(
        F.lit("App2ConsumerLagMessages").alias("metric_name"), F.col("pair_id").cast("string").alias("dim_value"),
        F.col("max_lag").cast("double").alias("value"), F.col("observed_ms").alias("ts_ms"), F.lit(0).cast("bigint").alias("sample_no"),
    )
    signals = t.control_signals(spark, sf_dir).filter(F.col("signal_type").isin(*modes.MODE_OF))
    sink_modes = signals.select(
        F.lit("SinkMode").alias("metric_name"), F.col("target_app_id").alias("dim_value"),
        scalars.mode_number(modes.signal_mode(F.col("signal_type"))).cast("double").alias("value"),
        F.col("timestamp").alias("ts_ms"), (F.col("trace_no") * 16 + F.col("offset") % 16).alias("sample_no"),
    )
    done = handoff_outcomes(spark, sf_dir).filter(F.col("duration_ms").isNotNull())
    durations = done.select(
        F.lit("HandoffDurationMs").alias("metric_name"), F.col("pair_id").cast("string").alias("dim_value"),
        F.col("duration_ms").cast("double").alias("value"), F.col("finished_ms").alias("ts_ms"),
        F.substring("trace_id", 2, 20).cast("bigint").alias("sample_no"),
    )
    return metrics.union_metrics(lags, sink_modes, durations)


@query
def sustained_alerts(spark, sf_dir):
    return alerts.sustained_alerts(stored(_samples(spark, sf_dir), "samples"), ALERT_RULES)


@query
def metrics_long(spark, sf_dir):
    outcomes = stored(handoff_outcomes(spark, sf_dir), "outcomes")
    end = F.lit(t.JANUARY + t.TICK * t.TICKS)
    return metrics.union_metrics(
        metrics.metric_rows(mode_timeline(spark, sf_dir), "SinkMode", scalars.mode_number(F.col("mode")), F.col("valid_from_ms"), F.col("app_id")),
        metrics.metric_rows(max_lag(spark, sf_dir), "App2ConsumerLagMessages", F.col("max_lag"), F.col("observed_ms")),
        metrics.metric_rows(outcomes, "HandoffState", scalars.handoff_state_number(F.col("state")), F.col("finished_ms"), F.col("state")),
        metrics.metric_rows(outcomes.filter(F.col("duration_ms").isNotNull()), "HandoffDurationMs", F.col("duration_ms"), F.col("finished_ms")),
        metrics.metric_rows(shadow_gate_counts(spark, sf_dir), "ShadowDropCount", F.col("dropped"), end, F.col("app_id")),
        metrics.metric_rows(split_brain_intervals(spark, sf_dir), "SplitBrainDetected", F.lit(1), F.col("from_ms"), F.col("pair_id")),
    )


# -- leadership and locks


@query
def leader_transfers(spark, sf_dir):
    return leases.leader_transfers(t.leader_attempts(spark, sf_dir), t.leaders(spark, sf_dir))


@query
def lease_replay(spark, sf_dir):
    return leases.lease_replay(t.lease_ops(spark, sf_dir))


@query
def lock_holders(spark, sf_dir):
    """Who held each lock half way through the log."""
    middle = t.lease_ops(spark, sf_dir).agg(F.expr("max(at_s) div 2").alias("now_s")).first()["now_s"]
    return leases.lock_holders(lease_intervals(spark, sf_dir), middle)


@query
def lease_intervals(spark, sf_dir):
    ops = t.lease_ops(spark, sf_dir)
    hot = leases.hot_locks(ops)
    return leases.lease_intervals(leases.lease_replay(ops, hot=hot), hot=hot)


@query
def pair_status(spark, sf_dir):
    now_s = t.lease_ops(spark, sf_dir).agg(F.max("at_s").alias("now_s")).first()["now_s"]
    current = leases.current_leaders(leader_transfers(spark, sf_dir), t.leaders(spark, sf_dir))
    holders = leases.lock_holders(lease_intervals(spark, sf_dir), now_s)
    return status.pair_status(t.pairs(spark, sf_dir), handoff_outcomes(spark, sf_dir), current, max_lag(spark, sf_dir), holders)


# -- verification, snapshots, migration


@query
def state_hash(spark, sf_dir):
    return verify.hash_states(customer_state_latest(spark, sf_dir))


@query
def state_digest(spark, sf_dir):
    return verify.table_digest(state_hash(spark, sf_dir))


def agreed_cuts(events: DataFrame) -> dict[str, dict[int, int]]:
    """Three agreed positions, at quarters of the offsets of each partition; one row per partition reaches the driver."""
    tops = events.groupBy("partition").agg(F.max("offset").alias("top")).collect()
    return {f"{i}/4": {r["partition"]: r["top"] * i // 4 for r in tops} for i in (1, 2, 3)}


@query
def state_digest_at_offsets(spark, sf_dir):
    """The digest of the state at three agreed offsets, from the changes alone."""
    events = t.known_business_events(spark, sf_dir)
    changes = fold.customer_state_changes(events, ("offset", "partition"))
    return verify.digests_at(verify.digest_steps(changes), agreed_cuts(events))


@query
def state_hash_diff(spark, sf_dir):
    states = customer_state_latest(spark, sf_dir)
    return verify.state_hash_diff(verify.hash_states(states), verify.hash_states(t.app2_states(states)))


@query
def split_invariance(spark, sf_dir):
    events = t.known_business_events(spark, sf_dir)
    middle = events.agg(F.expr("max(seq) div 2").alias("at")).first()["at"]
    return verify.split_invariance(events, middle)


MIGRATIONS = savepoints.Migrations()


@MIGRATIONS.step(1, 2)
def _add_tier(states: DataFrame) -> DataFrame:
    return states.withColumn("tier_level", F.lit("STANDARD"))


@MIGRATIONS.step(2, 3)
def _add_frequent(states: DataFrame) -> DataFrame:
    return states.withColumn("frequent", F.col("order_count") >= 5)


@query
def state_migration(spark, sf_dir):
    number = F.col("customer_id").cast("bigint")
    mixed = customer_state_latest(spark, sf_dir).withColumns({
        "state_version": (1 + number % 3).cast("int"),
        "tier_level": F.when(number % 3 > 0, "GOLD"),
        "frequent": F.when(number % 3 == 2, False),
    })
    return MIGRATIONS.migrate(mixed, 3)


@query
def savepoint_latest_completed(spark, sf_dir):
    return savepoints.latest_completed(t.savepoints(spark, sf_dir)).withColumn("kafka_offsets", scalars.offsets_text(F.col("kafka_offsets")))


@query
def savepoint_by_id(spark, sf_dir):
    return savepoints.by_id(t.savepoints(spark, sf_dir), "s1234").withColumn("kafka_offsets", scalars.offsets_text(F.col("kafka_offsets")))


@query
def savepoint_current_status(spark, sf_dir):
    return savepoints.current_status(t.savepoint_versions(spark, sf_dir))


@query
def scalar_functions(spark, sf_dir):
    key = F.col("o_orderkey")
    names = F.array(*[F.lit(s) for s in (*schemas.HANDOFF_STATES, "DRAINING")])
    ids = F.array(
        F.concat(F.lit("KafkaSourceReader.currentOffset.partition-"), key), F.concat(F.lit("reader_P"), key, F.lit(".currentOffset")),
        F.concat(F.lit("Partition_"), key % 24), F.lit("KafkaSourceReader.currentOffset"),
    )
    prefixes = F.array(F.lit("/a/b/"), F.lit(""), F.lit("//a"), F.lit("a/b"))
    return t.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        scalars.mode_number(F.when(key % 2 == 0, "ACTIVE").otherwise("SHADOW")).alias("mode_number"),
        scalars.handoff_state_number(F.element_at(names, (key % 9 + 1).cast("int"))).alias("state_number"),
        scalars.metric_partition(F.element_at(ids, (key % 4 + 1).cast("int"))).alias("metric_partition"),
        scalars.snapshot_path(
            F.lit("bucket"), F.element_at(prefixes, (key % 4 + 1).cast("int")), t.epoch_ms("o_orderdate"), F.concat(F.lit("id"), key)
        ).alias("path"),
    )
