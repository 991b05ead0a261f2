"""Offsets of the two copies: lag, readiness, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tandem.functions.scalars import metric_partition
from tandem.operators import alerts
from tandem.operators.small import join_small


def committed_offsets(snapshots: DataFrame, group_id: str, topic: str) -> DataFrame:
    rows = snapshots.filter((F.col("group_id") == group_id) & (F.col("topic") == topic))
    return rows.select("pair_id", "partition", "offset", "observed_ms")


def offsets_from_metrics(metrics: DataFrame) -> DataFrame:
    """Source positions out of job metrics; metrics that name no partition are left out."""
    rows = metrics.withColumn("partition", metric_partition(F.col("metric_id"))).filter(F.col("partition").isNotNull())
    return rows.select("pair_id", "observed_ms", "partition", F.col("value").cast("bigint").alias("offset"))


def partition_lag(snapshots: DataFrame, topic: str, app1: str = "app1", app2: str = "app2") -> DataFrame:
    """How far the second copy is behind the first, per partition and tick.

    Both groups are read in one aggregation instead of a join. A partition unknown to the second copy lags
    from 0, one known only to it is left out.
    """
    rows = snapshots.filter((F.col("topic") == topic) & F.col("group_id").isin(app1, app2))
    wide = rows.groupBy("pair_id", "observed_ms", "partition").agg(
        F.max(F.when(F.col("group_id") == app1, F.col("offset"))).alias("app1_offset"),
        F.max(F.when(F.col("group_id") == app2, F.col("offset"))).alias("app2_offset"),
    )
    lag = F.greatest(F.lit(0).cast("bigint"), F.col("app1_offset") - F.coalesce("app2_offset", F.lit(0).cast("bigint")))
    return wide.filter(F.col("app1_offset").isNotNull()).withColumn("lag", lag)


def max_lag(lags: DataFrame) -> DataFrame:
    """The lag that decides, per pair and tick; ticks without any offset of the second copy are unknown and skipped."""
    worst = lags.groupBy("pair_id", "observed_ms").agg(F.max("lag").alias("max_lag"), F.count("app2_offset").alias("_known"))
    return worst.filter(F.col("_known") > 0).drop("_known")


def ready_times(max_lags: DataFrame, stable_ms: int, threshold: int = 0) -> DataFrame:
    """When the second copy had kept up for ``stable_ms``; once per unbroken stretch.

    A pair watched for long is cut into chunks of ticks: a stretch that began in an earlier chunk is carried on by
    the chunk's summary, and its rows are reduced before they meet. ``max_lags`` is read twice, so store what is
    costly to derive.
    """
    found = alerts.sustained(max_lags, ["pair_id"], ["observed_ms"], F.col("max_lag") <= threshold, F.lit(stable_ms), strict=False)
    return found.select("pair_id", F.col("run_start_ms").alias("zero_since_ms"), F.col("fired_ms").alias("ready_ms"))


def worst_partitions(lags: DataFrame, k: int) -> DataFrame:
    """The k partitions of each pair with the highest lag seen at any tick.

    Lags are reduced to one row per partition first, so the ranking sees partitions, not ticks.
    """
    peak = lags.groupBy("pair_id", "partition").agg(F.max("lag").alias("max_lag"))
    rank = F.row_number().over(Window.partitionBy("pair_id").orderBy(F.desc("max_lag"), "partition"))
    return peak.withColumn("rank", rank).filter(F.col("rank") <= k)


def retention_gap(saved: DataFrame, earliest: DataFrame) -> DataFrame:
    """Saved positions whose next records are no longer kept in the topic.

    ``earliest`` has one row per partition of a pair.
    """
    joined = join_small(saved, earliest, ["pair_id", "partition"])
    gap = joined.filter(F.col("offset") < F.col("earliest"))
    return gap.withColumn("missing", F.col("earliest") - F.col("offset"))
