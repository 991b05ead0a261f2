"""Column functions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tandem.schemas import ACTIVE, HANDOFF_STATES


def mode_number(mode: Column) -> Column:
    """0 for SHADOW, 1 for ACTIVE."""
    return F.when(mode == ACTIVE, 1).otherwise(0)


def handoff_state_number(state: Column) -> Column:
    """Place of the state in its lifecycle, -1 when unknown."""
    place = F.array_position(F.array(*[F.lit(s) for s in HANDOFF_STATES]), F.upper(state)) - 1
    return F.coalesce(place, F.lit(-1)).cast("int")


def metric_partition(metric_id: Column) -> Column:
    """The partition number in a source metric name, NULL for aggregates."""
    # fixed value: how partition numbers are written in metric names
    digits = F.regexp_extract(metric_id, r"(?i)(?:partition[\-_]|[\-_]p)(\d+)", 1)
    return F.when(digits != "", digits).cast("int")


def snapshot_path(bucket: Column, prefix: Column, taken_at_ms: Column, snapshot_id: Column) -> Column:
    """Where a state snapshot lies; slashes around the prefix do not matter."""
    trimmed = F.regexp_replace(prefix, "^/+|/+$", "")
    name = F.concat(F.lit("sp-"), taken_at_ms.cast("string"), F.lit("-"), snapshot_id)
    folder = F.when(trimmed != "", trimmed)
    return F.concat(F.lit("s3://"), F.concat_ws("/", bucket, folder, name))


def offsets_text(offsets: Column) -> Column:
    """A map of offsets as text in partition order, for comparing and printing."""
    entries = F.array_sort(F.map_entries(offsets))
    text = F.array_join(F.transform(entries, lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string"))), ",")
    return F.when(offsets.isNotNull(), text)


def offset_at(offsets: Column, partition: Column, default: int = 0) -> Column:
    return F.coalesce(F.try_element_at(offsets, partition), F.lit(default).cast("bigint"))


def state_hash(columns: Sequence[Column], present: Column | None = None) -> Column:
    """SHA-256 of the JSON of the columns in the given order; a missing state hashes to the text null.

    Pass amounts as integer cents, since decimals and doubles print differently between engines.
    """
    digest = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    return digest if present is None else F.when(present, digest).otherwise(F.lit("null"))
