"""Business and control topics: reading positions and decoding records.

Every function takes rows shaped like a topic (``value`` plus whatever position columns there are), so the
same decoders serve a live topic, a file stream and a batch of stored records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.schemas import BUSINESS_EVENT_WIRE, CONTROL_SIGNAL_WIRE, SIGNAL_TYPES

# wire types; map keys are read as text because JSON has no other
_BUSINESS_JSON = "eventId STRING, customerId STRING, eventType STRING, amount DECIMAL(18,2), eventTimestamp BIGINT, payload STRING"
_CONTROL_JSON = (
    "signalType STRING, targetAppId STRING, sourceAppId STRING, cutoverOffsets MAP<STRING,BIGINT>, "
    "coordinatorId STRING, timestamp BIGINT, traceId STRING, reason STRING, _bad STRING"
)


def read_topic(spark: SparkSession, brokers: str, topic: str, starting: str = "earliest", max_per_trigger: int | None = None) -> DataFrame:
    """A topic as a stream. ``starting`` is earliest, latest, or the JSON of offsets per partition.

    Business topics start at earliest, control topics at latest; later runs go on from the query's own
    checkpoint. Needs the Kafka connector on the class path.
    """
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", brokers)
        .option("subscribe", topic)
        .option("startingOffsets", starting)
    )
    if max_per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", max_per_trigger)
    return reader.load().select("topic", "partition", "offset", "timestamp", F.col("key").cast("string"), F.col("value").cast("string"))


def topic_positions(topic: str, next_offsets: dict[int, int]) -> str:
    """``startingOffsets`` that continue a snapshot; give the next offset per partition."""
    inner = ", ".join(f'"{p}": {o}' for p, o in sorted(next_offsets.items()))
    return f'{{"{topic}": {{{inner}}}}}'


def encode_business_events(*extra: Column) -> Column:
    """The JSON text of an event row."""
    return F.to_json(F.struct(*[F.col(c).alias(w) for c, w in BUSINESS_EVENT_WIRE.items()], *extra))


def _kept(raw: DataFrame, decoded: dict) -> list[Column]:
    """The position columns; one with the name of a decoded field, as the topic's own timestamp, gets a prefix."""
    return [F.col(c).alias(f"topic_{c}") if c in decoded else F.col(c) for c in raw.columns if c != "value"]


def decode_business_events(raw: DataFrame) -> DataFrame:
    """Decode strictly: a malformed or empty record fails the job, unknown fields are ignored, missing numbers are 0."""
    kept = _kept(raw, BUSINESS_EVENT_WIRE)
    decoded = F.from_json("value", _BUSINESS_JSON, {"mode": "FAILFAST"})
    rows = raw.withColumn("v", F.coalesce(decoded, F.raise_error(F.lit("empty business record"))))
    out = rows.select(*kept, *[F.col(f"v.{wire}").alias(name) for name, wire in BUSINESS_EVENT_WIRE.items()])
    return out.withColumns({
        "amount": F.coalesce("amount", F.lit(0).cast("decimal(18,2)")),
        "event_ts_ms": F.coalesce("event_ts_ms", F.lit(0).cast("bigint")),
    })


def encode_control_signals(signals: DataFrame) -> DataFrame:
    """``key`` (the addressed app) and ``value`` (compact JSON, empty fields left out) of each signal."""
    fields = [F.col(c).alias(w) for c, w in CONTROL_SIGNAL_WIRE.items()]
    kept = [c for c in signals.columns if c not in CONTROL_SIGNAL_WIRE]
    return signals.select(*kept, F.col("target_app_id").alias("key"), F.to_json(F.struct(*fields)).alias("value"))


def read_control_records(raw: DataFrame) -> DataFrame:
    """Decode every record and mark in ``readable`` whether it is a signal.

    Empty records, text that is not JSON, wrong types, unknown signal types and offsets under keys that are
    no partition numbers are unreadable; their signal columns are NULL.
    """
    kept = _kept(raw, CONTROL_SIGNAL_WIRE)
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    # exploding the one record keeps filters above the parser, which would otherwise run once per use
    parsed = F.explode(F.array(F.from_json("value", _CONTROL_JSON, options)))
    rows = raw.select(*kept, parsed.alias("v"))
    keys_ok = F.coalesce(F.forall(F.map_keys("v.cutoverOffsets"), lambda k: k.rlike(r"^\d{1,9}$")), F.lit(True))
    readable = F.col("v").isNotNull() & F.col("v._bad").isNull() & F.col("v.signalType").isin(*SIGNAL_TYPES) & keys_ok
    rows = rows.withColumn("readable", F.coalesce(readable, F.lit(False)))
    columns = []
    for name, wire in CONTROL_SIGNAL_WIRE.items():
        value = F.col(f"v.{wire}")
        if name == "cutover_offsets":
            value = F.transform_keys(value, lambda k, _: F.try_to_number(k, F.lit("999999999")).cast("int"))
        if name == "timestamp":
            value = F.coalesce(value, F.lit(0).cast("bigint"))
        columns.append(F.when(F.col("readable"), value).alias(name))
    return rows.select(*[c for c in rows.columns if c not in ("v", "readable")], "readable", *columns)


def decode_control_signals(raw: DataFrame) -> DataFrame:
    """The readable signals; the rest is skipped and never stops the reader."""
    return read_control_records(raw).filter("readable").drop("readable")


def unreadable_records(raw: DataFrame) -> DataFrame:
    """How many records were read and skipped."""
    return read_control_records(raw).agg(
        F.count(F.lit(1)).alias("records"), F.count_if(~F.col("readable")).alias("skipped")
    )
