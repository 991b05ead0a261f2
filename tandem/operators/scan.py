"""Ordered running values per key that survive hot keys.

A plain window puts all rows of a key into one task. Here a key that holds more rows than one
task should see is cut into chunks of its order column. Each chunk is scanned on its own, each chunk
leaves one summary row, the summaries of a key are scanned, and every row is completed with the value
carried into its chunk. Keys that are not hot keep the plain window, with one shuffle and no join.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_CHUNK_CONF = "tandem.scan.rowsPerChunk"
ROWS_PER_CHUNK = 2_000_000
# Rows of a scan that one task should sort; with more rows the scan gets more tasks than the session's shuffles.
ROWS_PER_TASK_CONF = "tandem.scan.rowsPerTask"
ROWS_PER_TASK = 1_000_000
# A key over 1/MAX_HOT_KEYS of all rows is always among the collected ones, so what is collected and
# broadcast has a fixed bound while the largest unsplit key stays below that share.
MAX_HOT_KEYS = 50_000
# Chunks are cut at equal widths of the order column; cutting finer absorbs uneven density.
OVERSPLIT = 4

# A chunk that still holds too many rows, since its rows lie dense, is cut again, LEVELS times in all. The
# numbers of all levels share one BIGINT.
LEVELS = 3
PART_BITS = 21
# Counters of the sketch that keeps the search for hot keys from shuffling all distinct keys.
SKETCH_BUCKETS = 1 << 18

CHUNK = "_chunk"


@dataclass(frozen=True)
class HotKeys:
    """Keys to be cut. Each level has the origin and chunk width per key, or per chunk of the level before.

    ``rows`` is the number of all rows counted in the search, 0 where none was made.
    """

    keys: tuple[str, ...]
    by: str
    levels: tuple[DataFrame, ...] = ()
    rows: int = 0

    @property
    def found(self) -> bool:
        return bool(self.levels)

    @property
    def partition(self) -> list[str]:
        return [*self.keys, CHUNK] if self.found else list(self.keys)

    def finer(self, keys: Sequence[str], by: str) -> HotKeys | None:
        """For keys that split these: if no key here is hot, none of theirs can be; else unknown."""
        return None if self.found else HotKeys(tuple(keys), by, rows=self.rows)


def find_hot_keys(df: DataFrame, keys: Sequence[str], by: str) -> HotKeys:
    """Count rows per key and keep the keys over the chunk size.

    ``by`` is the integer column that leads the order of the scan. Without hot keys one pass over the key columns
    builds the sketch and that is all. Further passes read two columns: one of the rows in large buckets, then one per
    level of chunks to cut again.
    """
    rows, count = _in_large_buckets(df.select(*dict.fromkeys([*keys, by])), keys)
    hot = HotKeys(tuple(keys), by, rows=count)
    if rows is None:
        return hot
    while len(hot.levels) < LEVELS:
        groups = rows if not hot.found else with_chunk(rows, hot).filter(F.col(CHUNK) >= 0)
        cut = _oversized(groups, hot.partition, by)
        if cut is None:
            break
        hot = HotKeys(hot.keys, by, (*hot.levels, cut), count)
    return hot


def _limit(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(ROWS_PER_CHUNK_CONF, str(ROWS_PER_CHUNK)))


def _in_large_buckets(rows: DataFrame, keys: Sequence[str]) -> tuple[DataFrame | None, int]:
    """The rows whose key can be hot, or None if none can, and the number of all rows.

    A sketch with one counter per hash bucket, added up on the map side: a task passes on at most ``SKETCH_BUCKETS``
    counters, however many keys it sees. A bucket has at least as many rows as any of its keys, so no hot key is missed,
    and rows of other keys in a large bucket only make the exact count after it longer.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(SKETCH_BUCKETS)).cast("int")
    counters = rows.groupBy(bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))
    large = F.collect_list(F.when(F.col("_n") > _limit(rows), F.col("_bucket")))
    found = counters.agg(F.sum("_n").alias("rows"), large.alias("large")).first()
    count = found["rows"] or 0
    if not found["large"]:
        return None, count
    buckets = F.broadcast(rows.sparkSession.createDataFrame([(b,) for b in found["large"]], "_bucket INT"))
    return rows.withColumn("_bucket", bucket).join(buckets, "_bucket", "left_semi").drop("_bucket"), count


def _oversized(df: DataFrame, groups: Sequence[str], by: str) -> DataFrame | None:
    """Groups with more rows than a chunk should have, with the lowest position and the width to cut them by."""
    spark = df.sparkSession
    limit = _limit(df)
    position = F.col(by).cast("bigint")
    counts = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"), F.min(position).alias("_lo"), F.max(position).alias("_hi"))
    # groups at one single position cannot be cut
    large = counts.filter((F.col("_n") > limit) & (F.col("_hi") > F.col("_lo"))).orderBy(F.desc("_n")).limit(MAX_HOT_KEYS)
    span = F.col("_hi") - F.col("_lo") + 1
    width = F.greatest(F.lit(1), F.floor(span * float(limit) / (F.col("_n") * OVERSPLIT)), F.ceil(span / 2.0**PART_BITS))
    found = large.select(*groups, "_lo", width.cast("bigint").alias("_width"))
    rows = found.collect()
    return spark.createDataFrame(rows, found.schema) if rows else None


def _number(by: str) -> Column:
    """The place of a row in its cut group, NULL if that is not cut; rows without a position go to the front."""
    steps = F.floor((F.coalesce(F.col(by), F.col("_lo")) - F.col("_lo")) / F.col("_width"))
    return F.when(F.col("_lo").isNotNull(), F.greatest(F.lit(0), steps)).cast("bigint")


def with_chunk(df: DataFrame, hot: HotKeys) -> DataFrame:
    """Add the chunk number, rising with the position; -1 for keys that stay whole."""
    out = df
    for level, cut in enumerate(hot.levels):
        unit = 1 << (PART_BITS * (LEVELS - 1 - level))
        out = out.join(F.broadcast(cut), [*hot.keys, *([CHUNK] if level else [])], "left")
        number = F.coalesce(_number(hot.by) * unit + (F.col(CHUNK) if level else 0), F.col(CHUNK) if level else F.lit(-1))
        out = out.withColumn(CHUNK, number.cast("bigint")).drop("_lo", "_width")
    return out


def spread(df: DataFrame, hot: HotKeys) -> DataFrame:
    """The rows dealt to the tasks of a scan, so many that one sorts about ``ROWS_PER_TASK`` however large the table is.

    Only where that is more than the session's shuffles have; else the window deals the rows itself.
    """
    spark = df.sparkSession
    tasks = -(-hot.rows // int(spark.conf.get(ROWS_PER_TASK_CONF, str(ROWS_PER_TASK))))
    return df.repartition(tasks, *hot.partition) if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")) else df


def chunk_window(hot: HotKeys, order: Sequence[str]):
    return Window.partitionBy(*hot.partition).orderBy(*order)


def carry(df: DataFrame, hot: HotKeys, summary: Sequence[Column], carried) -> DataFrame:
    """One row per chunk of a hot key with the values carried into it.

    ``summary`` reduces a chunk; ``carried(w)`` gives the columns computed over the earlier chunks, with
    ``w`` ordered by chunk. The number of rows is bounded by rows / chunk size, not by keys.
    """
    chunks = df.filter(F.col(CHUNK) >= 0).groupBy(*hot.partition).agg(*summary)
    over = Window.partitionBy(*hot.keys).orderBy(CHUNK)
    return chunks.select(*hot.partition, *carried(over))


def attach(df: DataFrame, carried: DataFrame, hot: HotKeys) -> DataFrame:
    """Join on exactly the columns the rows are already hashed by, so only the summaries move."""
    return df.join(carried, hot.partition, "left")


KINDS = ("sum", "max", "min", "last", "lag", "lead")


@dataclass(frozen=True)
class Running:
    """One running value: ``kind`` is sum, max, min, last (newest non-null), lag or lead.

    ``before`` leaves the current row out.
    """

    name: str
    kind: str
    value: Column
    before: bool = False

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"unknown running value {self.kind!r}")


def _local(spec: Running, window) -> Column:
    if spec.kind in ("lag", "lead"):
        step = F.lag if spec.kind == "lag" else F.lead
        return step(F.struct(spec.value.alias("v"))).over(window)
    frame = window.rowsBetween(Window.unboundedPreceding, -1 if spec.before else Window.currentRow)
    if spec.kind == "last":
        return F.last(spec.value, ignorenulls=True).over(frame)
    return getattr(F, spec.kind)(spec.value).over(frame)


def _summary(spec: Running, order: Sequence[str]) -> Column:
    position = F.struct(*order)
    if spec.kind == "last":
        return F.max_by(spec.value, F.when(spec.value.isNotNull(), position))
    if spec.kind == "lag":
        return F.max_by(F.struct(spec.value.alias("v")), position)
    if spec.kind == "lead":
        return F.min_by(F.struct(spec.value.alias("v")), position)
    return getattr(F, spec.kind)(spec.value)


def _carried(spec: Running, column: Column, window) -> Column:
    earlier = window.rowsBetween(Window.unboundedPreceding, -1)
    if spec.kind == "last":
        return F.last(column, ignorenulls=True).over(earlier)
    if spec.kind == "lag":
        return F.lag(column).over(window)
    if spec.kind == "lead":
        return F.lead(column).over(window)
    return getattr(F, spec.kind)(column).over(earlier)


def _combine(spec: Running, local: Column, carried: Column) -> Column:
    if spec.kind in ("last", "lag", "lead"):
        return F.coalesce(local, carried)
    if spec.kind == "sum":
        # NULL only when neither side has a value, as for a plain running sum
        return F.coalesce(local + carried, local, carried)
    return (F.greatest if spec.kind == "max" else F.least)(local, carried)


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], *specs: Running, hot: HotKeys | None = None) -> DataFrame:
    """Add one column per spec, scanning each key in ``order`` (ascending; the first column an integer).

    Pass ``hot`` when several scans go over the same keys, so that they are counted once.
    """
    hot = hot or find_hot_keys(df, keys, order[0])
    window = chunk_window(hot, order)
    if not hot.found:
        out = spread(df, hot).withColumns({s.name: _local(s, window) for s in specs})
    else:
        chunked = with_chunk(df, hot)
        totals = [_summary(s, order).alias(f"_s_{s.name}") for s in specs]
        before = carry(
            chunked, hot, totals,
            lambda over: [_carried(s, F.col(f"_s_{s.name}"), over).alias(f"_c_{s.name}") for s in specs],
        )
        out = attach(spread(chunked, hot).withColumns({s.name: _local(s, window) for s in specs}), before, hot)
        out = out.withColumns({s.name: _combine(s, F.col(s.name), F.col(f"_c_{s.name}")) for s in specs})
        out = out.drop(CHUNK, *[f"_c_{s.name}" for s in specs])
    steps = {s.name: F.col(f"{s.name}.v") for s in specs if s.kind in ("lag", "lead")}
    return out.withColumns(steps) if steps else out
