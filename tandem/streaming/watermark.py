"""Event time for monitoring only; the fold itself never drops late records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: how far event time may fall behind.
OUT_OF_ORDERNESS = "5 seconds"


def with_event_time(events: DataFrame, delay: str = OUT_OF_ORDERNESS) -> DataFrame:
    return events.withColumn("event_at", F.timestamp_millis("event_ts_ms")).withWatermark("event_at", delay)


def hourly_counts(events: DataFrame) -> DataFrame:
    """Events per type and closed hour.

    The watermark is one value for the whole input, so an idle partition cannot hold it back and needs no
    timeout of its own.
    """
    counted = with_event_time(events).groupBy(F.window("event_at", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("events"))
    return counted.select(F.unix_millis("window.start").alias("hour_ms"), "event_type", "events")
