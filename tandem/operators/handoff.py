"""What became of each handoff, read from its log rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.operators.cutover import has_offsets
from tandem.operators.modes import POSITION
from tandem.operators.scan import Running, find_hot_keys, running

# Time limits of the two waits and the reasons of failures.
DRAIN_TIMEOUT_MS = 60_000
PROMOTE_TIMEOUT_MS = 30_000
DRAIN_TIMEOUT = "App1 drain timeout"
SAVEPOINT_FAILED = "Savepoint did not complete successfully"
TRANSFER_REFUSED = "Leader transfer refused"
ABORTED = "Aborted"


def handoff_outcomes(log: DataFrame, order: Sequence[str] = POSITION, drain_ms: int = DRAIN_TIMEOUT_MS, promote_ms: int = PROMOTE_TIMEOUT_MS) -> DataFrame:
    """State, reason and times per trace, taking the log as finished.

    Each step counts only after the step before it, so two scans along the trace first note the PREPARE
    and the DRAINED_AT in force at every row; one aggregation then picks the first of each step. A PREPARE without
    offsets is ignored.
    """
    keys = ["pair_id", "trace_id"]
    kind, ts = F.col("signal_type"), F.col("timestamp")
    place = F.struct(*order, ts.alias("ts"))
    prepares = (kind == "PREPARE_HANDOFF") & has_offsets(F.col("cutover_offsets"))
    traced = log.filter(F.col("trace_id").isNotNull()).select(*keys, *order, "signal_type", "timestamp", "reason", prepares.alias("prepares"))
    hot = find_hot_keys(traced, keys, order[0])

    rows = running(traced, keys, order, Running("prepare", "min", F.when(F.col("prepares"), place)), hot=hot)
    in_time = ts <= F.col("prepare.ts") + drain_ms
    rows = running(rows, keys, order, Running("drain", "min", F.when((kind == "DRAINED_AT") & in_time, place)), hot=hot)

    reason = (
        F.when(kind == "SAVEPOINT_FAILED", SAVEPOINT_FAILED)
        .when(kind == "TRANSFER_REFUSED", TRANSFER_REFUSED)
        .otherwise(F.coalesce("reason", F.lit(ABORTED)))
    )
    stops = (
        (kind == "HANDOFF_ABORT")
        | ((kind == "SAVEPOINT_FAILED") & F.col("prepare").isNull())
        | ((kind == "TRANSFER_REFUSED") & F.col("drain").isNotNull())
    )
    confirms = (kind == "PROMOTED_CONFIRMED") & F.col("drain").isNotNull() & (ts <= F.col("drain.ts") + promote_ms)
    traces = rows.groupBy(*keys).agg(
        F.coalesce(F.min(F.when(kind == "TRIGGER", ts)), F.min(place)["ts"]).alias("triggered_ms"),
        F.min("prepare").alias("prepare"),
        F.min("drain").alias("drain"),
        F.min(F.when(stops, F.struct(place.alias("at"), reason.alias("reason")))).alias("stop"),
        F.min(F.when(confirms, place)).alias("confirm"),
    )
    return _resolve(traces, drain_ms, promote_ms)


def _resolve(traces: DataFrame, drain_ms: int, promote_ms: int) -> DataFrame:
    """Turn the first row of each step into the outcome of a trace."""
    stop, prepare, drain, confirm = (F.col(c) for c in ("stop.at", "prepare", "drain", "confirm"))
    stopped = F.col("stop").isNotNull()
    prepared = prepare.isNotNull() & ~(stopped & (stop < prepare))
    drained = prepared & drain.isNotNull() & ~(stopped & (stop < drain))
    confirmed = drained & confirm.isNotNull() & ~(stopped & (stop < confirm))
    # a stop within the wait ends it, a later one finds the handoff already settled by the time limit
    stop_in_drain = stopped & (stop["ts"] <= prepare["ts"] + drain_ms)
    stop_in_promote = stopped & (stop["ts"] <= drain["ts"] + promote_ms)
    none = F.lit(None)
    cases: list[tuple[Column, str, Column, Column]] = [
        (confirmed, "HANDOFF_COMPLETE", none, confirm["ts"]),
        (drained & stop_in_promote, "HANDOFF_FAILED", F.col("stop.reason"), stop["ts"]),
        (drained, "HANDOFF_COMPLETE", none, drain["ts"] + promote_ms),
        (prepared & stop_in_drain, "HANDOFF_FAILED", F.col("stop.reason"), stop["ts"]),
        (prepared, "HANDOFF_FAILED", F.lit(DRAIN_TIMEOUT), prepare["ts"] + drain_ms),
        (stopped, "HANDOFF_FAILED", F.col("stop.reason"), stop["ts"]),
    ]
    # the unconfirmed default: no savepoint result yet, still waiting
    state, why, end = F.lit("WAITING_FOR_APP2_CATCHUP"), none.cast("string"), none.cast("bigint")
    for holds, name, text, at in reversed(cases):
        holds = F.coalesce(holds, F.lit(False))
        state = F.when(holds, name).otherwise(state)
        why = F.when(holds, text).otherwise(why)
        end = F.when(holds, at).otherwise(end)
    out = traces.select(
        "pair_id", "trace_id", state.alias("state"), why.alias("reason"),
        (F.coalesce(drained, F.lit(False)) & ~F.coalesce(confirmed, F.lit(False)) & ~F.coalesce(stop_in_promote, F.lit(False))).alias("assumed"),
        "triggered_ms",
        F.when(prepared, prepare["ts"]).alias("prepared_ms"),
        F.when(drained, drain["ts"]).alias("drained_ms"),
        F.when(confirmed, confirm["ts"]).alias("confirmed_ms"),
        end.alias("finished_ms"),
    )
    complete = F.col("state") == "HANDOFF_COMPLETE"
    return out.withColumns({
        "duration_ms": F.when(complete, F.col("finished_ms") - F.col("triggered_ms")),
        "prepare_to_confirm_ms": F.when(complete, F.col("confirmed_ms") - F.col("prepared_ms")),
    })


def handoff_durations(outcomes: DataFrame) -> DataFrame:
    """How long completed handoffs took, per pair: from the trigger, and from PREPARE to the confirmation."""
    done = outcomes.filter(F.col("state") == "HANDOFF_COMPLETE")
    return done.groupBy("pair_id").agg(
        F.count(F.lit(1)).alias("completed"),
        F.count_if("assumed").alias("assumed"),
        F.avg("duration_ms").alias("avg_duration_ms"),
        F.percentile_approx("duration_ms", 0.5, 10000).alias("median_duration_ms"),
        F.max("duration_ms").alias("max_duration_ms"),
        F.avg("prepare_to_confirm_ms").alias("avg_prepare_to_confirm_ms"),
        F.max("prepare_to_confirm_ms").alias("max_prepare_to_confirm_ms"),
    )


def drain_verification(signals: DataFrame, order: Sequence[str] = POSITION) -> DataFrame:
    """Whether the drained offsets of a trace reach the agreed ones on every partition.

    The two maps of a trace meet in one aggregation and are compared in place, without exploding them.
    """
    kind = F.col("signal_type")
    place = F.struct(*order)

    def first(name: str) -> Column:
        return F.min_by("cutover_offsets", F.when(kind == name, place))

    rows = signals.filter(kind.isin("PREPARE_HANDOFF", "DRAINED_AT") & F.col("trace_id").isNotNull())
    maps = rows.groupBy("pair_id", "trace_id").agg(first("PREPARE_HANDOFF").alias("target"), first("DRAINED_AT").alias("drained"))
    # a prepare without offsets is ignored
    maps = maps.filter(has_offsets(F.col("target")))
    empty = F.create_map().cast("map<int,bigint>")
    reached = F.coalesce("drained", empty)
    short = F.filter(
        F.map_keys("target"),
        lambda p: F.coalesce(F.try_element_at(reached, p), F.lit(-1).cast("bigint")) < F.element_at("target", p),
    )
    out = maps.withColumn("short", F.size(short))
    return out.select(
        "pair_id", "trace_id", F.size("target").alias("partitions"), F.col("short").alias("partitions_short"),
        F.col("drained").isNotNull().alias("reported"), (F.col("short") == 0).alias("drained_ok"),
    )
