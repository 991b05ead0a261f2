"""One row per pair with what an operator asks first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pair_status(pairs: DataFrame, outcomes: DataFrame, leaders: DataFrame, max_lags: DataFrame, holders: DataFrame) -> DataFrame:
    """Latest handoff state, leader, latest lag, lock holder and readiness.

    Every input is reduced to one row per pair before it is joined. A pair is ready while its lock is held
    and its last handoff did not fail.
    """
    last = outcomes.groupBy("pair_id").agg(F.max(F.struct("triggered_ms", "trace_id", "state")).alias("s"))
    lags = max_lags.groupBy("pair_id").agg(F.max_by("max_lag", "observed_ms").alias("max_lag"))
    locks = holders.select(F.col("lock_id").alias("pair_id"), "holder")
    joined = (
        pairs.select("pair_id")
        .join(last.select("pair_id", "s.state", "s.trace_id"), "pair_id", "left")
        .join(leaders.select("pair_id", "leader", "version"), "pair_id", "left")
        .join(lags, "pair_id", "left")
        .join(locks, "pair_id", "left")
    )
    state = F.coalesce("state", F.lit("IDLE"))
    return joined.select(
        "pair_id", state.alias("state"), "trace_id", "leader", F.coalesce("version", F.lit(0)).cast("bigint").alias("version"), "max_lag", "holder",
        (F.col("holder").isNotNull() & (state != "HANDOFF_FAILED")).alias("ready"),
    )
