"""Runs of a condition along a series: sustained alerts, lag readiness, heartbeat silences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.operators.scan import HotKeys, Running, find_hot_keys, running


def runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], condition: Column, hot: HotKeys | None = None) -> DataFrame:
    """Rows where the condition holds, each with ``run_start_ms``, the first ``order[0]`` of its unbroken run."""
    hot = hot or find_hot_keys(df, keys, order[0])
    flagged = df.withColumn("_on", F.coalesce(condition, F.lit(False)))
    stepped = running(flagged, keys, order, Running("_was", "lag", F.col("_on")), hot=hot)
    start = F.when(F.col("_on") & ~F.coalesce("_was", F.lit(False)), F.col(order[0]))
    marked = running(stepped, keys, order, Running("run_start_ms", "last", start), hot=hot)
    return marked.filter("_on").drop("_on", "_was")


def sustained(df: DataFrame, keys: Sequence[str], order: Sequence[str], condition: Column, duration_ms: Column, strict: bool = True, *extra: Column, hot: HotKeys | None = None) -> DataFrame:
    """One row per run that lasted: when it began, when it had lasted for ``duration_ms``, when last seen."""
    at = F.col(order[0])
    age = at - F.col("run_start_ms")
    reached = age > duration_ms if strict else age >= duration_ms
    out = runs(df, keys, order, condition, hot).groupBy(*keys, "run_start_ms").agg(
        F.min(F.when(reached, at)).alias("fired_ms"), F.max(at).alias("last_seen_ms"), *extra
    )
    return out.filter(F.col("fired_ms").isNotNull())


def sustained_alerts(samples: DataFrame, rules: Sequence[tuple[str, str, str, float, int]]) -> DataFrame:
    """Alerts from data rules (rule, metric, op, threshold, seconds) over metric samples.

    The rules are a handful of rows given by the caller; op is one of > >= < <= =.
    """
    spark = samples.sparkSession
    table = spark.createDataFrame(list(rules), "rule string, metric_name string, op string, threshold double, seconds bigint")
    rows = samples.join(F.broadcast(table), "metric_name")
    value, limit, op = F.col("value"), F.col("threshold"), F.col("op")
    holds = (
        F.when(op == ">", value > limit)
        .when(op == ">=", value >= limit)
        .when(op == "<", value < limit)
        .when(op == "<=", value <= limit)
        .otherwise(value == limit)
    )
    keys = ["rule", "metric_name", "dim_value"]
    kept = rows.select(*keys, "ts_ms", "sample_no", "value", "seconds", holds.alias("holds"))
    return sustained(
        kept, keys, ["ts_ms", "sample_no"], F.col("holds"), F.col("seconds") * 1000, True,
        F.count(F.lit(1)).alias("samples"), F.max("value").alias("max_value"),
    )


def heartbeat_gaps(beats: DataFrame, timeout_ms: int, end_ms: int | None = None) -> DataFrame:
    """Silences longer than the timeout, the one still open at the end of the log included.

    The end is the newest beat of any app unless given. Reported only; no mode follows from it.
    """
    end = F.lit(end_ms) if end_ms is not None else F.lit(beats.agg(F.max("ts_ms").alias("end_ms")).first()["end_ms"])
    order = ["ts_ms", "seq"]
    seen = running(beats, ["app_id"], order, Running("next_ms", "lead", F.col("ts_ms")))
    silence = F.coalesce("next_ms", end.cast("bigint")) - F.col("ts_ms")
    out = seen.select("app_id", F.col("ts_ms").alias("last_beat_ms"), F.col("next_ms").alias("next_beat_ms"), silence.alias("silence_ms"))
    return out.filter(F.col("silence_ms") > timeout_ms).withColumn("still_open", F.col("next_beat_ms").isNull())
