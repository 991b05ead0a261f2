"""Splitting a topic between two copies at agreed offsets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.operators.modes import POSITION, signals_delivered
from tandem.operators.scan import Running, running
from tandem.operators.small import join_small

# What ends the wait of a copy for its cutover: a newer one, an abort, or its own demotion.
ENDS_PENDING = ("PREPARE_HANDOFF", "HANDOFF_ABORT", "DEMOTE")


def has_offsets(offsets: Column) -> Column:
    """Whether a signal carries offsets; a PREPARE without them is ignored."""
    return F.coalesce(F.size(offsets), F.lit(0)) > 0


def moves_pending(signals: DataFrame) -> DataFrame:
    """The signals that set or clear a pending cutover."""
    kind = F.col("signal_type")
    return signals.filter(kind.isin(*ENDS_PENDING) & ((kind != "PREPARE_HANDOFF") | has_offsets(F.col("cutover_offsets"))))


def cutover_from_committed(committed: DataFrame) -> DataFrame:
    """The last offset of the old copy; a committed offset is the next one to read."""
    return committed.select("pair_id", "partition", (F.col("offset") - 1).alias("cutover"))


def explode_offsets(rows: DataFrame, offsets: str, *keep: str) -> DataFrame:
    """A map of offsets per row as one row per partition."""
    return rows.select(*keep, F.explode(offsets).alias("partition", "cutover"))


def cutover_split(records: DataFrame, cutover: DataFrame) -> DataFrame:
    """``side`` is OLD up to and including the cutover, NEW after it, NONE where no offset was agreed."""
    joined = join_small(records, cutover, ["pair_id", "partition"], "left")
    side = F.when(F.col("cutover").isNull(), "NONE").when(F.col("offset") <= F.col("cutover"), "OLD").otherwise("NEW")
    return joined.withColumn("side", side)


def pending_cutovers(signals: DataFrame, pairs: DataFrame, order: Sequence[str] = POSITION) -> DataFrame:
    """Per PREPARE with offsets and copy that receives it: how long its cutover is pending, ``ends_ms`` is NULL if to the end."""
    keys = ["pair_id", "app_id"]
    rows = signals_delivered(moves_pending(signals), pairs).select(*keys, *order, "signal_type", "trace_id", "timestamp", "cutover_offsets")
    rows = running(rows, keys, order, Running("ends_ms", "lead", F.col("timestamp")))
    return rows.filter(F.col("signal_type") == "PREPARE_HANDOFF").select(
        *keys, *order, "trace_id", F.col("timestamp").alias("prepared_ms"), "ends_ms", "cutover_offsets"
    )


def drained(pending: DataFrame, positions: DataFrame, order: Sequence[str] = POSITION) -> DataFrame:
    """The pending cutovers that a copy reached on every partition before something ended them, and when.

    ``positions(pair_id, app_id, partition, offset, at_ms)`` are offsets that a copy has read. A signal comes before
    positions of the same millisecond. For each target the first time of an offset at or beyond it is a running
    minimum from the highest offset down: one scan, no range join.
    """
    keys = ["pair_id", "app_id"]
    targets = explode_offsets(pending, "cutover_offsets", *keys, *order)
    # targets come after the records of the same offset
    reads = positions.select(*keys, "partition", (F.col("offset") * -2).alias("place"), "at_ms")
    asked = targets.select(*keys, *order, "partition", (F.col("cutover") * -2 + 1).alias("place"))
    rows = running(reads.unionByName(asked, allowMissingColumns=True), [*keys, "partition"], ["place"], Running("reached_ms", "min", F.col("at_ms")))
    reached = rows.filter(F.col(order[0]).isNotNull()).groupBy(*keys, *order).agg(
        F.max("reached_ms").alias("reached_ms"), F.bool_and(F.col("reached_ms").isNotNull()).alias("all_reached")
    )
    out = pending.join(reached.filter("all_reached"), [*keys, *order])
    in_time = (F.col("reached_ms") < F.col("prepared_ms")) | F.col("ends_ms").isNull() | (F.col("reached_ms") < F.col("ends_ms"))
    return out.filter(in_time).select(*keys, "trace_id", "prepared_ms", F.greatest("prepared_ms", "reached_ms").alias("drained_ms"), "cutover_offsets")


def cutovers_in_force(changes: DataFrame) -> DataFrame:
    """``(pair_id, partition, cutover)``: the offsets of the last PREPARE of each pair, unless an abort came after it."""
    last = changes.groupBy("pair_id").agg(F.max_by("cutover_offsets", F.struct("place1", "place2")).alias("offsets"))
    return explode_offsets(last.filter(has_offsets(F.col("offsets"))), "offsets", "pair_id")
