"""The gated sink and the table it writes."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.operators import cutover, upsert
from tandem.operators.modes import POSITION
from tandem.operators.small import join_small
from tandem.schemas import ACTIVE, CUTOVER_CHANGE
from tandem.sources.topics import encode_control_signals
from tandem.streaming.runtime import not_written_yet, writer_run

WriteFn = Callable[[DataFrame, int], None]


class NewerWinsTable:
    """Key to newest value, kept as appended batches that are merged when read.

    Keeping the newest version (the earliest write among equals) does not depend on the order or number of
    merges, so a batch only adds its own survivors: nothing is read or locked to write, two writers cannot
    harm each other, and a batch that runs again rewrites its own files. A stream with a new checkpoint adds to what
    earlier ones wrote under its name. ``compact`` bounds what readers merge.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, version: str, order: str) -> None:
        self._spark, self._path, self._schema = spark, path, schema
        self._key, self._version, self._order = key, version, order

    def writer(self, name: str) -> WriteFn:
        """A write function for one stream; ``name`` keeps the batches of several writers apart."""

        def write(batch: DataFrame, batch_id: int) -> None:
            run = writer_run(batch.sparkSession)
            self._survivors(batch).write.mode("overwrite").parquet(f"{self._path}/written={name}-{run}-{batch_id}")

        return write

    def _survivors(self, rows: DataFrame) -> DataFrame:
        columns = rows.columns
        # the position is kept as a value too, since later merges need it to break ties
        kept = rows.withColumn("_at", F.col(self._order))
        best = upsert.conditional_upsert(kept, self._key, self._version, [self._order])
        return best.withColumnRenamed("_at", self._order).select(*columns)

    def read(self) -> DataFrame:
        try:
            rows = self._spark.read.schema(f"{self._schema}, written STRING").parquet(self._path).drop("written")
        except AnalysisException as error:
            if not not_written_yet(error):
                raise
            rows = self._spark.createDataFrame([], self._schema)
        return self._survivors(rows).drop(self._order)

    def _batches(self) -> list:
        """The folders of the batches that are complete, by name."""
        path = self._spark._jvm.org.apache.hadoop.fs.Path(self._path)
        files = path.getFileSystem(self._spark._jsc.hadoopConfiguration())
        folders = [s.getPath() for s in files.listStatus(path) if s.isDirectory()] if files.exists(path) else []
        done = self._spark._jvm.org.apache.hadoop.fs.Path
        return [f for f in folders if f.getName().startswith("written=") and files.exists(done(f, "_SUCCESS"))]

    def compact(self, path: str | None = None) -> NewerWinsTable:
        """The same content in one batch, under a new path or in place.

        In place, exactly the complete batches that are there at the start are merged into one and then deleted, so
        writers may go on meanwhile: what they add lies in other folders. A batch that is both in the merged set and
        still in its own folder changes nothing for readers; a reader that is at work during the deletion fails
        and has to read again.
        """
        old = self._batches()
        if old:
            rows = self._spark.read.schema(self._schema).parquet(*[f.toString() for f in old])
            self._survivors(rows).write.parquet(f"{path or self._path}/written=compacted-{uuid.uuid4().hex}")
        if path:
            return NewerWinsTable(self._spark, path, self._schema, self._key, self._version, self._order)
        for folder in old:
            folder.getFileSystem(self._spark._jsc.hadoopConfiguration()).delete(folder, True)
        return self


class GateCounts:
    """Written and dropped records per app, one row per batch."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._spark, self._path = spark, path

    def add(self, app_id: str, batch_id: int, written: int, dropped: int) -> None:
        row = self._spark.range(1).select(F.lit(written).cast("bigint").alias("written"), F.lit(dropped).cast("bigint").alias("dropped"))
        row.write.mode("overwrite").parquet(f"{self._path}/app_id={app_id}/run={writer_run(self._spark)}/batch={batch_id}")

    def read(self) -> DataFrame:
        rows = self._spark.read.schema("written BIGINT, dropped BIGINT, app_id STRING, run STRING, batch BIGINT").parquet(self._path)
        return rows.groupBy("app_id").agg(F.sum("written").alias("written"), F.sum("dropped").alias("dropped"))


def shadow_sink(app_id: str, write_fn: WriteFn, mode_fn: Callable[[str], str], counts: GateCounts | None = None) -> WriteFn:
    """Wrap any batch writer: while the app is ACTIVE it writes, otherwise the batch is dropped and counted.

    The mode is read once per batch. The batch is computed in either mode, since only that moves the state of
    the stream on; it is kept while it is counted and written, so that it is computed once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        active = mode_fn(app_id) == ACTIVE
        batch.persist()
        try:
            rows = batch.count()
            if active:
                write_fn(batch, batch_id)
        finally:
            batch.unpersist()
        if counts is not None:
            counts.add(app_id, batch_id, rows if active else 0, 0 if active else rows)

    return write


def cutover_sink(side: str, write_fn: WriteFn, offsets: DataFrame | Callable[[], DataFrame], unsplit: str | None = None) -> WriteFn:
    """Wrap a writer so that it writes only its side (OLD or NEW) of the agreed offsets.

    The split depends on the record alone, so no record is lost or written by both copies. ``offsets`` is a table, or
    a function that is asked for one per batch. Pairs without any agreed offset are written by the side ``unsplit``.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        agreed = offsets() if callable(offsets) else offsets
        split = cutover.cutover_split(batch, agreed)
        own = F.col("side") == side
        if unsplit == side:
            known = agreed.select("pair_id").distinct().withColumn("agreed", F.lit(True))
            split = join_small(split, known, ["pair_id"], "left")
            own = own | F.col("agreed").isNull()
        write_fn(split.filter(own).select(*batch.columns), batch_id)

    return write


def cutovers_from_table(spark: SparkSession, path: str) -> Callable[[], DataFrame]:
    """The offsets in force, from the table that the control stream writes; none before its first row."""

    def offsets() -> DataFrame:
        try:
            changes = spark.read.schema(CUTOVER_CHANGE).parquet(path)
        except AnalysisException as error:
            if not not_written_yet(error):
                raise
            changes = spark.createDataFrame([], CUTOVER_CHANGE)
        return cutover.cutovers_in_force(changes)

    return offsets


def latest_modes(changes: DataFrame, order: Sequence[str] = POSITION) -> DataFrame:
    """The mode in force per app, from a table of mode changes."""
    last = changes.groupBy("app_id").agg(F.max(F.struct(*order, "mode")).alias("s"))
    return last.select("app_id", "s.mode")


def mode_from_table(spark: SparkSession, path: str, initial: str, order: Sequence[str] = POSITION) -> Callable[[str], str]:
    """A mode function that reads the table written by the control stream, so a restart keeps the mode."""

    def mode(app_id: str) -> str:
        try:
            changes = spark.read.parquet(path).filter(F.col("app_id") == app_id)
        except AnalysisException as error:
            if not not_written_yet(error):
                raise
            return initial
        row = latest_modes(changes, order).first()
        return row["mode"] if row else initial

    return mode


def send_signals(signals: DataFrame, brokers: str, topic: str) -> None:
    """Publish control signals, keyed by the addressed app. Needs the Kafka connector on the class path."""
    rows = encode_control_signals(signals).select("key", "value")
    rows.write.format("kafka").option("kafka.bootstrap.servers", brokers).option("topic", topic).save()
