"""Operational metrics in long form."""

from __future__ import annotations

import logging
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAMESPACE = "Standby"
LOG = logging.getLogger(__name__)

# Metric names with their dimension and unit.
METRICS = {
    "SinkMode": ("AppId", "None"),
    "App2ConsumerLagMessages": (None, "Count"),
    "HandoffState": ("State", "None"),
    "ShadowDropCount": ("AppId", "Count"),
    "SplitBrainDetected": ("AppId", "Count"),
    "HandoffDurationMs": (None, "Milliseconds"),
}


def metric_rows(df: DataFrame, name: str, value: Column, ts_ms: Column, dimension: Column | None = None) -> DataFrame:
    dim_name, unit = METRICS[name]
    return df.select(
        F.lit(NAMESPACE).alias("namespace"),
        F.lit(name).alias("metric_name"),
        F.lit(dim_name).cast("string").alias("dim_name"),
        (dimension if dimension is not None else F.lit(None)).cast("string").alias("dim_value"),
        value.cast("double").alias("value"),
        F.lit(unit).alias("unit"),
        ts_ms.cast("bigint").alias("ts_ms"),
    )


def union_metrics(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def append_metrics(df: DataFrame, path: str) -> bool:
    """Append to the metric table; a failure is logged and never reaches the job."""
    try:
        df.write.mode("append").parquet(path)
        return True
    except Exception:
        LOG.exception("metrics not written")
        return False
