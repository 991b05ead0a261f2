"""Starting streams, and replaying stored tables through them."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from itertools import pairwise

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def use_state_store(spark: SparkSession) -> None:
    """RocksDB with changelog checkpoints: state may exceed memory and each batch uploads only its changes."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


ENCODING_CONF = "spark.sql.streaming.stateStore.encodingFormat"


@contextmanager
def evolving_states(spark: SparkSession) -> Iterator[None]:
    """Streams started inside store their states as Avro, so that their checkpoint can go on with wider ones.

    A checkpoint keeps the format it was begun with. Only streams of state processors can use this one; Spark refuses it
    for its own stateful operators, as aggregations, so it holds for the streams started inside and no longer.
    """
    before = spark.conf.get(ENCODING_CONF, None)
    spark.conf.set(ENCODING_CONF, "avro")
    try:
        yield
    finally:
        spark.conf.unset(ENCODING_CONF) if before is None else spark.conf.set(ENCODING_CONF, before)


PARTITIONS_CONF = "spark.sql.shuffle.partitions"


@contextmanager
def replay_partitions(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in no more partitions than there are cores, 8 at least.

    Each task of a state processor starts a Python worker of its own, a second or two whatever it reads, in every
    micro-batch. A checkpoint keeps the number it was begun with.
    """
    before = spark.conf.get(PARTITIONS_CONF)
    spark.conf.set(PARTITIONS_CONF, str(min(int(before), max(8, spark.sparkContext.defaultParallelism))))
    try:
        yield
    finally:
        spark.conf.set(PARTITIONS_CONF, before)


def writer_run(spark: SparkSession) -> str:
    """The id of the streaming query whose batch is being written, ``direct`` outside of one.

    It is kept in the checkpoint: a restart has the same id, a stream with a new checkpoint, whose batch numbers
    begin again, another one.
    """
    return spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "direct"


def not_written_yet(error: AnalysisException) -> bool:
    """Whether a read failed since the table has no files so far; any other failure must not pass for that."""
    return error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def stream_table(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A stored parquet table (a file or a folder of files) read as a stream, optionally bounded per micro-batch."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # a stream wants a folder or a pattern; this pattern fits a file, or a folder, of exactly this name
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def start_to_table(df: DataFrame, path: str, checkpoint: str, output_mode: str = "append") -> StreamingQuery:
    """Append everything available to a parquet table; the sink's log makes replayed batches harmless."""
    writer = df.writeStream.format("parquet").outputMode(output_mode).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start(path)


def start_batches(df: DataFrame, write_batch, checkpoint: str, output_mode: str = "append") -> StreamingQuery:
    """Hand everything available to ``write_batch(batch, batch_id)``."""
    return df.writeStream.foreachBatch(write_batch).outputMode(output_mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(df: DataFrame, folder: str, schema=None) -> DataFrame:
    """Run a stream over all stored input and give back what it wrote."""
    out = f"{folder}/out"
    spark = df.sparkSession
    with replay_partitions(spark):
        stream = start_to_table(df, out, f"{folder}/checkpoint")
    stream.awaitTermination()
    return spark.read.schema(schema or df.schema).parquet(out)


def run_batches(df: DataFrame, write_batch, checkpoint: str, output_mode: str = "append") -> None:
    with replay_partitions(df.sparkSession):
        stream = start_batches(df, write_batch, checkpoint, output_mode)
    stream.awaitTermination()


# Rows of a replay that one micro-batch takes, about: a key's share of them is sorted in one task.
ROWS_PER_BATCH_CONF = "tandem.replay.rowsPerBatch"
ROWS_PER_BATCH = 4_000_000
# Files of a micro-batch, so that many tasks write and read one.
FILES_PER_BATCH = 8
# Tables with fewer rows than this get one file per micro-batch.
SMALL_TABLE = 1_000_000


@dataclass(frozen=True)
class Staged:
    """A table written as files in the order of a position column, for one stream to read in that order."""

    folder: str
    files_per_batch: int

    def stream(self, spark: SparkSession) -> DataFrame:
        """The table as a stream that takes the next ``files_per_batch`` files at a time."""
        return stream_table(spark, self.folder, self.files_per_batch)


def stage(rows: DataFrame, position: str, folder: str, batches: int = 1) -> Staged:
    """Write a table for a replay: one stream gets it in arrival order, in at least ``batches`` bounded micro-batches.

    Files hold neighbouring ranges of the position. A file stream takes files by their modification time, so these are
    set in the order of the ranges: a millisecond from one to the next, the last one now. A file system that does not
    keep times that are set, as object stores, is refused.
    """
    spark = rows.sparkSession
    limit = int(spark.conf.get(ROWS_PER_BATCH_CONF, str(ROWS_PER_BATCH)))
    count = rows.count()
    per_batch = FILES_PER_BATCH if count >= SMALL_TABLE else 1
    files = max(batches, -(-count // limit)) * per_batch
    rows.repartitionByRange(files, position).write.parquet(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def written() -> list:
        found = [f for f in system.listStatus(path) if f.getPath().getName().startswith("part-")]
        return sorted(found, key=lambda f: f.getPath().getName())

    in_order = written()
    newest = max((f.getModificationTime() for f in in_order), default=0)
    for number, file in enumerate(in_order):
        system.setTimes(file.getPath(), newest - (len(in_order) - 1 - number), -1)
    times = [f.getModificationTime() for f in written()]
    if any(a >= b for a, b in pairwise(times)):
        raise RuntimeError(f"{folder}: this file system does not keep the order of files; set spark.checkpoint.dir to one that does")
    return Staged(folder, per_batch)
