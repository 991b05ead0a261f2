"""Inputs of the registered queries, derived from the generic test tables row by row.

Derivations use integer arithmetic only and need no shuffle, except the offset snapshots. Positions
(``seq``, ``offset``) are taken from ids, so they grow but are not dense, as in a compacted topic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tandem.functions.scalars import snapshot_path
from tandem.operators.fold import KNOWN_TYPES, amount_to_cents, cents_to_amount
from tandem.operators.modes import POSITION
from tandem.session import prepare
from tandem.sources.topics import encode_business_events, encode_control_signals

PAIRS = 25
PARTITIONS = 24
TOPIC = "business-events"
JANUARY = 1704067200000  # 2024-01-01 UTC in ms, where the events start
JANUARY_SECONDS = 2678400
HOUR = 3600000
TICK = 6 * HOUR
TICKS = 124

EVENT_TYPES = {
    "purchase": "ORDER_CREATED",
    "view": "ORDER_UPDATED",
    "error": "ORDER_CANCELLED",
    "click": "ORDER_VIEWED",
    "signup": "ORDER_UNKNOWN",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_ms(column: str) -> Column:
    return F.unix_millis(F.col(column).cast("timestamp"))


def to_business_events(events: DataFrame) -> DataFrame:
    kind = F.lit(None).cast("string")
    for raw, name in EVENT_TYPES.items():
        kind = F.when(F.col("event_type") == raw, name).otherwise(kind)
    cents = F.round(F.col("value") * 100).cast("bigint")
    signed = F.when((F.col("event_type") == "view") & (F.col("event_id") % 2 == 1), -cents).otherwise(cents)
    return events.select(
        F.concat(F.lit("e"), F.col("event_id")).alias("event_id"),
        F.col("event_id").alias("seq"),
        F.col("user_id").cast("string").alias("customer_id"),
        (F.col("user_id") % PAIRS).cast("int").alias("pair_id"),
        kind.alias("event_type"),
        cents_to_amount(signed).alias("amount"),
        epoch_ms("ts").alias("event_ts_ms"),
        (F.col("user_id") % PARTITIONS).cast("int").alias("partition"),
        F.col("event_id").alias("offset"),
        F.col("props").alias("payload"),
    )


def business_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_business_events(table(spark, sf_dir, "events"))


def folded_events(events: DataFrame) -> DataFrame:
    """The raw events of the types that fold; stated on the raw column, so that the scan can skip the rest."""
    return events.filter(F.col("event_type").isin(*[raw for raw, name in EVENT_TYPES.items() if name in KNOWN_TYPES]))


def known_business_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_business_events(folded_events(table(spark, sf_dir, "events")))


def shuffled(events: DataFrame) -> DataFrame:
    """Arrival of the folding types moved by up to 1,600 places, so event time goes backwards within a customer."""
    turn = F.col("seq") % 5
    return events.withColumn("seq", (F.col("seq") + 400 * turn) * 5 + 4 - turn).withColumn("offset", F.col("seq"))


def business_events_ooo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shuffled(known_business_events(spark, sf_dir))


def business_events_coarse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event time of the folding types cut to hours, so that writes of a customer tie."""
    hour = F.floor(F.col("event_ts_ms") / HOUR) * HOUR
    return known_business_events(spark, sf_dir).withColumn("event_ts_ms", hour.cast("bigint"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey").cast("int")
    return table(spark, sf_dir, "nation").select(
        key.alias("pair_id"),
        F.concat(F.lit("app1-"), key).alias("app1"),
        F.concat(F.lit("app2-"), key).alias("app2"),
    )


# Signals of one handoff; the place is their rank among those of one trace and millisecond.
SIGNALS = (
    "TRIGGER",
    "SAVEPOINT_FAILED",
    "PREPARE_HANDOFF",
    "HEARTBEAT",
    "DRAINED_AT",
    "TRANSFER_REFUSED",
    "PROMOTE",
    "DEMOTE",
    "PROMOTED_CONFIRMED",
    "HANDOFF_ABORT",
)


def _by_signal(cases: dict[str, Column], default: Column) -> Column:
    out = default
    for name, value in cases.items():
        out = F.when(F.col("signal_type") == name, value).otherwise(out)
    return out


def to_control_log(orders: DataFrame) -> DataFrame:
    """One handoff per order: its trigger and outcome rows from the coordinator, and its wire signals.

    Status F confirms, P never confirms, O drains too late. The position of a row is (offset, trace_no).
    Only the signal names are exploded; every other column is computed after that, if a query asks for it.
    """
    key = F.col("o_orderkey")
    pair = (F.col("o_custkey") % PAIRS).cast("int")
    named = orders.select(
        key.alias("trace_no"),
        pair.alias("pair_id"),
        F.col("o_orderstatus").alias("status"),
        (F.lit(JANUARY) + (key * 7919) % JANUARY_SECONDS * 1000).cast("bigint").alias("t0"),
        F.posexplode(F.array(*[F.lit(s) for s in SIGNALS])).alias("rank", "signal_type"),
    )
    n, none = F.col("trace_no"), F.lit(None).cast("string")
    failed, refused, late = n % 19 == 0, n % 23 == 0, F.col("status") == "O"
    moved = ~failed & ~late & ~refused
    happens = _by_signal({
        "SAVEPOINT_FAILED": failed,
        "PREPARE_HANDOFF": ~failed,
        "DRAINED_AT": ~failed,
        "TRANSFER_REFUSED": ~failed & ~late & refused,
        "PROMOTE": moved,
        "DEMOTE": moved,
        "PROMOTED_CONFIRMED": moved & (F.col("status") == "F"),
        "HANDOFF_ABORT": ~failed & late,
    }, F.lit(True))
    after = _by_signal({
        "SAVEPOINT_FAILED": F.lit(500),
        "PREPARE_HANDOFF": F.lit(1000),
        "HEARTBEAT": F.lit(1500),
        "DRAINED_AT": F.when(late, 70000).otherwise(2000),
        "TRANSFER_REFUSED": F.lit(2400),
        "PROMOTE": F.lit(2500) + F.when(n % 13 == 0, HOUR).otherwise(0),
        "DEMOTE": F.lit(2600) + F.when(n % 11 == 0, HOUR).otherwise(0),
        "PROMOTED_CONFIRMED": F.lit(3000) + n % 500,
        "HANDOFF_ABORT": F.lit(61000),
    }, F.lit(0))
    gains = F.concat(F.when(n % 2 == 0, "app2-").otherwise("app1-"), F.col("pair_id"))
    loses = F.concat(F.when(n % 2 == 0, "app1-").otherwise("app2-"), F.col("pair_id"))
    everyone, coordinator = F.lit("broadcast"), F.lit("coordinator-1")
    short = F.when((F.col("signal_type") == "DRAINED_AT") & (n % 7 == 0), 1).otherwise(0)
    target = [F.lit(1000).cast("bigint") + (n + p) % 50 - (short if p == 0 else 0) for p in range(4)]
    offsets = F.map_from_arrays(F.array(*[F.lit(p) for p in range(4)]), F.array(*target))
    timed = named.filter(happens).withColumn("timestamp", (F.col("t0") + after).cast("bigint"))
    by_app = F.col("signal_type").isin("DRAINED_AT", "PROMOTED_CONFIRMED")
    return timed.select(
        "pair_id",
        (F.col("timestamp") * 16 + F.col("rank")).alias("offset"),
        "trace_no",
        "signal_type",
        _by_signal({**{name: none for name in LOG_ONLY}, "PROMOTE": gains, "DEMOTE": loses}, everyone).alias("target_app_id"),
        _by_signal({"DRAINED_AT": loses, "PROMOTED_CONFIRMED": gains}, coordinator).alias("source_app_id"),
        F.when(F.col("signal_type").isin("PREPARE_HANDOFF", "DRAINED_AT"), offsets).alias("cutover_offsets"),
        F.when(~by_app, coordinator).alias("coordinator_id"),
        "timestamp",
        F.when(F.col("signal_type") != "HEARTBEAT", F.concat(F.lit("t"), n)).alias("trace_id"),
        F.when(F.col("signal_type") == "HANDOFF_ABORT", "App1 drain timeout").alias("reason"),
    )


# Rows that the coordinator logs but does not send.
LOG_ONLY = ("TRIGGER", "SAVEPOINT_FAILED", "TRANSFER_REFUSED")


def control_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_control_log(table(spark, sf_dir, "orders"))


def control_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wire signals only."""
    return control_log(spark, sf_dir).filter(~F.col("signal_type").isin(*LOG_ONLY))


def cutover_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wire signals, with targets near the positions of ``copy_positions`` at their time; some PREPAREs have none."""
    n, second = F.col("trace_no"), F.floor((F.col("timestamp") - JANUARY) / 1000)
    targets = F.map_from_arrays(F.array(*[F.lit(p) for p in range(4)]), F.array(*[(second - (n * 131 + p * 1777) % 50000).cast("bigint") for p in range(4)]))
    prepare = (F.col("signal_type") == "PREPARE_HANDOFF") & (n % 17 != 0)
    return control_signals(spark, sf_dir).withColumn("cutover_offsets", F.when(prepare, targets))


def copy_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets that both copies have read: seconds of January as offsets, the second copy up to two hours behind."""
    events = table(spark, sf_dir, "events")
    pair, part, at = (F.col("user_id") % PAIRS).cast("int"), (F.col("event_id") % 4).cast("int"), epoch_ms("ts")
    offset = F.floor((at - JANUARY) / 1000).cast("bigint")
    copies = F.array(
        F.struct(F.concat(F.lit("app1-"), pair).alias("app_id"), at.alias("at_ms")),
        F.struct(F.concat(F.lit("app2-"), pair).alias("app_id"), (at + HOUR * (part % 3)).cast("bigint").alias("at_ms")),
    )
    return events.select(pair.alias("pair_id"), part.alias("partition"), offset.alias("offset"), F.explode(copies).alias("c")).select("pair_id", "c.app_id", "partition", "offset", "c.at_ms")


def agreed_signals(events: DataFrame) -> DataFrame:
    """For each pair a PREPARE without offsets, one that is aborted, and the one whose offsets count: the middle of each partition."""
    middle = events.groupBy("pair_id", "partition").agg(F.expr("max(offset) div 2").alias("cutover"))
    maps = middle.groupBy("pair_id").agg(F.map_from_entries(F.collect_list(F.struct("partition", "cutover"))).alias("middle"))
    early = F.transform_values("middle", lambda _, v: F.floor(v / 2).cast("bigint"))
    steps = F.array(*[
        F.struct(F.lit(i).cast("bigint").alias("offset"), F.lit(kind).alias("signal_type"), F.lit(trace).alias("trace_id"), offsets.alias("cutover_offsets"))
        for i, (kind, trace, offsets) in enumerate([
            ("PREPARE_HANDOFF", "a", early), ("HANDOFF_ABORT", "a", F.lit(None).cast("map<int,bigint>")), ("PREPARE_HANDOFF", "b", F.col("middle")),
            ("PREPARE_HANDOFF", "c", F.lit(None).cast("map<int,bigint>")),
        ])
    ])
    none = F.lit(None).cast("string")
    rows = maps.select("pair_id", "middle", F.explode(steps).alias("s")).select("pair_id", "s.*")
    return rows.select(
        "pair_id", "offset", "signal_type", F.concat(F.lit("app1-"), "pair_id").alias("target_app_id"), none.alias("source_app_id"), "cutover_offsets",
        F.lit("coordinator-1").alias("coordinator_id"), F.col("offset").alias("timestamp"), "trace_id", none.alias("reason"),
    )


def control_topic(pair: Column) -> Column:
    """The control topic of a pair."""
    return F.concat(F.lit("control-"), pair)


def as_topic(signals: DataFrame, offset: str | Column) -> DataFrame:
    """Signals as rows of the control topics of their pairs, with the six columns that a topic has and no others."""
    rows = encode_control_signals(signals)
    return rows.select(
        control_topic(F.col("pair_id")).alias("topic"), F.lit(0).alias("partition"), (F.col(offset) if isinstance(offset, str) else offset).alias("offset"),
        F.lit(None).cast("timestamp").alias("timestamp"), "key", "value",
    )


def topic_offset() -> Column:
    """The place of a signal in the topic of its pair, by time and trace."""
    return (F.col("offset") - JANUARY * 16) * (1 << 24) + F.col("trace_no")


def topic_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).withColumn("topic", control_topic(F.col("pair_id")))


def offset_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Committed offsets of both copies at every tick of January, plus rows of another topic.

    Events are reduced to the last offset per partition and hour first, so the running maximum goes over
    hours, not events.
    """
    hour = F.ceil(F.col("event_ts_ms") / HOUR) * HOUR
    events = business_events(spark, sf_dir)
    hourly = events.groupBy("pair_id", "partition", hour.cast("bigint").alias("mark")).agg((F.max("offset") + 1).alias("next"))
    # an hour holds for both copies until the next hour with events
    marks = F.sequence(F.lit(JANUARY + TICK), F.lit(JANUARY + TICK * TICKS), F.lit(TICK))
    keys = hourly.select("pair_id", "partition").distinct()
    ticks = keys.select("pair_id", "partition", F.explode(marks).alias("observed_ms"))
    late = F.when(F.floor(F.col("observed_ms") / TICK) % 10 < 4, 0).otherwise(HOUR * (F.col("partition") % 5))
    asked = ticks.select(
        "pair_id", "partition", "observed_ms",
        F.explode(F.array(
            F.struct(F.lit("app1").alias("group_id"), F.col("observed_ms").alias("mark")),
            F.struct(F.lit("app2").alias("group_id"), (F.col("observed_ms") - late).cast("bigint").alias("mark")),
        )).alias("g"),
    ).select("pair_id", "partition", "observed_ms", "g.*")
    both = hourly.unionByName(asked, allowMissingColumns=True)
    over = Window.partitionBy("pair_id", "partition").orderBy("mark", F.col("observed_ms").asc_nulls_first())
    known = both.withColumn("offset", F.max("next").over(over)).filter(F.col("group_id").isNotNull() & F.col("offset").isNotNull())
    tick_no = F.floor(F.col("observed_ms") / TICK)
    missing = (F.col("group_id") == "app2") & (tick_no % 17 == 0) & (F.col("partition") % 6 == 0)
    own = known.filter(~missing).select("pair_id", "group_id", F.lit(TOPIC).alias("topic"), "partition", "offset", "observed_ms")
    return own.select(
        "pair_id", "group_id", "partition", "observed_ms",
        F.explode(F.array(
            F.struct(F.lit(TOPIC).alias("topic"), F.col("offset").alias("offset")),
            F.struct(F.lit("other-topic").alias("topic"), (F.col("offset") + 999).alias("offset")),
        )).alias("t"),
    ).select("pair_id", "group_id", "t.topic", "partition", "t.offset", "observed_ms")


def heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_heartbeats(table(spark, sf_dir, "events"))


def to_heartbeats(events: DataFrame) -> DataFrame:
    return events.filter(F.col("event_type") == "click").select(
        F.col("user_id").cast("string").alias("app_id"),
        epoch_ms("ts").alias("ts_ms"),
        F.col("event_id").alias("seq"),
    )


def raw_business_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as topic records, with a field the decoder does not know."""
    return as_business_records(business_events(spark, sf_dir))


def as_business_records(events: DataFrame) -> DataFrame:
    return events.select("partition", "offset", encode_business_events(F.lit(1).alias("extra")).alias("value"))


def record_no() -> Column:
    return F.col("trace_no") * 10 + F.col("offset") % 16


def raw_control_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wire signals as topic records, some of them unreadable."""
    return as_control_records(control_signals(spark, sf_dir))


def as_control_records(signals: DataFrame) -> DataFrame:
    odd = (
        F.when(record_no() % 97 == 0, "not-json")
        .when(record_no() % 89 == 0, "")
        .when(record_no() % 83 == 0, '{"signalType":"REBOOT","timestamp":1}')
        .when(record_no() % 79 == 0, '{"signalType":"HEARTBEAT","timestamp":"soon"}')
    )
    return encode_control_signals(signals).select("pair_id", *POSITION, F.coalesce(odd, F.col("value")).alias("value"))


def job_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source positions of app1 as job metrics, with an aggregate that names no partition."""
    rows = offset_snapshots(spark, sf_dir).filter((F.col("group_id") == "app1") & (F.col("topic") == TOPIC))
    part = F.col("partition").cast("string")
    names = F.array(
        F.when(F.col("partition") % 2 == 0, F.concat(F.lit("KafkaSourceReader.currentOffset.partition-"), part))
        .otherwise(F.concat(F.lit("KafkaSourceReader.KafkaSourceReader-p"), part, F.lit(".currentOffset"))),
        F.lit("KafkaSourceReader.currentOffset"),
    )
    return rows.select("pair_id", "observed_ms", F.explode(names).alias("metric_id"), F.col("offset").cast("string").alias("value"))


def earliest_retained(spark: SparkSession, sf_dir: str, kept_from_ms: int) -> DataFrame:
    """The first offset per partition that a time-based retention still keeps."""
    kept = business_events(spark, sf_dir).filter(F.col("event_ts_ms") >= kept_from_ms)
    return kept.groupBy("pair_id", "partition").agg(F.min("offset").alias("earliest"))


def savepoint_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each snapshot as registered and, once it ended, its status update a minute later."""
    states = F.array(
        F.struct(F.lit("IN_PROGRESS").alias("status"), F.lit(0).alias("after")),
        F.when(F.col("status") != "IN_PROGRESS", F.struct(F.col("status").alias("status"), F.lit(60000).alias("after"))),
    )
    return savepoints(spark, sf_dir).select(
        "savepoint_id", "source_job_id", "location", "taken_at_ms",
        F.explode(F.filter(states, lambda v: v.isNotNull())).alias("v"),
    ).select("savepoint_id", "source_job_id", "location", (F.col("taken_at_ms") + F.col("v.after")).alias("changed_ms"), "v.status")


def app2_states(states: DataFrame) -> DataFrame:
    """The second copy's states: some a cent off, some missing."""
    number = F.col("customer_id").cast("bigint")
    off = F.when(number % 37 == 0, 1).otherwise(0)
    return states.filter(number % 41 != 0).withColumn(
        "total_amount", cents_to_amount(amount_to_cents(F.col("total_amount")) + off)
    )


def leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("pair_id", F.lit("app1").alias("app"), F.lit(1).alias("version"))


def savepoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    offsets = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda p: F.lit(1000).cast("bigint") + (key + p) % 50)
    status = F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "O", "IN_PROGRESS").otherwise("FAILED")
    taken = epoch_ms("o_orderdate") + key % 86400 * 1000
    name = F.concat(F.lit("s"), key)
    return table(spark, sf_dir, "orders").select(
        name.alias("savepoint_id"),
        snapshot_path(F.lit("snapshots"), F.lit("/jobs/state/"), taken, name).alias("location"),
        F.concat(F.lit("job-"), F.col("o_custkey") % 50).alias("source_job_id"),
        taken.alias("taken_at_ms"),
        F.map_from_arrays(F.array(*[F.lit(p) for p in range(4)]), offsets).alias("kafka_offsets"),
        status.alias("status"),
        key.alias("savepoint_no"),
    )


def leader_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, pair = F.col("o_orderkey"), (F.col("o_custkey") % PAIRS).cast("int")
    even = key % 2 == 0
    return table(spark, sf_dir, "orders").select(
        pair.alias("pair_id"),
        F.when(even, "app1").otherwise("app2").alias("from_app"),
        F.when(even, "app2").otherwise("app1").alias("to_app"),
        F.expr("1 + o_orderkey div 200").alias("expected_version"),
        key.alias("seq"),
    )


def lease_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    turn = key % 4
    return table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 50).cast("int").alias("lock_id"),
        F.concat(F.lit("c"), key % 3).alias("coordinator_id"),
        F.when(turn < 2, "ACQUIRE").when(turn == 2, "RENEW").otherwise("RELEASE").alias("op"),
        F.expr("o_orderkey div 2").alias("at_s"),
        key.alias("seq"),
    )
