"""The conditional "newer wins" write, over a batch of writes and as an audit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.operators.scan import Running, running


def conditional_upsert(writes: DataFrame, key: str, version: str, order: Sequence[str], current: DataFrame | None = None) -> DataFrame:
    """The table after applying ``writes`` one by one in ``order``, each kept only if strictly newer.

    The survivor of a key is its newest version and, among equals, the earliest write. Rows already in
    ``current`` were written before all others, so they join the same reduction with no position, and no
    join against the table is needed. Reduced on the map side, so a hot key is one row per task in the shuffle.
    """
    value = [c for c in writes.columns if c not in (key, version, *order)]
    # NULL sorts lowest, so a present row is marked by 1 and beats every write of the same version
    rank = F.struct(
        F.col(version).alias("version"),
        F.lit(0).alias("present"),
        *[(-F.col(c)).alias(f"back_{c}") for c in order],
        *[F.col(c) for c in value],
    )
    rows = writes.select(key, rank.alias("s"))
    if current is not None:
        kept = F.struct(
            F.col(version).alias("version"),
            F.lit(1).alias("present"),
            *[F.lit(None).cast(f.dataType).alias(f"back_{f.name}") for f in writes.schema.fields if f.name in order],
            *[F.col(c) for c in value],
        )
        rows = rows.unionByName(current.select(key, kept.alias("s")))
    best = rows.groupBy(key).agg(F.max("s").alias("s"))
    return best.select(key, F.col("s.version").alias(version), *[F.col(f"s.{c}").alias(c) for c in value])


def conditional_write_audit(writes: DataFrame, key: str, version: str, order: Sequence[str]) -> DataFrame:
    """Whether each write was accepted, or was stale against the newest version written before it."""
    seen = running(writes, [key], order, Running("stored_version", "max", F.col(version), before=True))
    accepted = F.col("stored_version").isNull() | (F.col(version) > F.col("stored_version"))
    return seen.withColumn("accepted", accepted)


def key_value_items(states: DataFrame) -> DataFrame:
    """States as items for a key-value store: every field as text, missing fields left out."""
    names = F.array(*[F.lit(c) for c in states.columns])
    values = F.array(*[F.col(c).cast("string") for c in states.columns])
    return states.select(F.map_filter(F.map_from_arrays(names, values), lambda _, v: v.isNotNull()).alias("item"))
