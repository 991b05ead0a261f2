"""Offsets that running streams have read, as rows of ``offset_snapshot``, from the progress they report."""

from __future__ import annotations

import json
import logging
from collections.abc import Mapping
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from tandem.operators.scan import Running, running
from tandem.schemas import OFFSET_SNAPSHOT
from tandem.streaming.runtime import not_written_yet

LOG = logging.getLogger(__name__)


def offset_rows(progress: Mapping, pair_id: int, group_id: str) -> list[tuple]:
    """The rows of one progress report, in the columns of ``offset_snapshot``: the next offset to read per partition.

    A topic source reports offsets by topic and partition. A file source reports the number of its last list of files,
    which counts as partition 0 of a topic named by its description. Sources that have read nothing give no row.
    """
    at = int(datetime.fromisoformat(progress["timestamp"].replace("Z", "+00:00")).timestamp() * 1000)
    rows = []
    for source in progress["sources"]:
        end = source.get("endOffset")
        end = json.loads(end) if isinstance(end, str) and end[:1] in "{[" else end
        if not isinstance(end, Mapping):
            continue
        if "logOffset" in end:
            if int(end["logOffset"]) >= 0:
                rows.append((pair_id, group_id, source["description"], 0, int(end["logOffset"]) + 1, at))
            continue
        for topic, parts in end.items():
            rows += [(pair_id, group_id, topic, int(part), int(offset), at) for part, offset in parts.items()]
    return rows


class OffsetListener(StreamingQueryListener):
    """Appends the offsets of named queries to a table. ``copies`` gives the pair and the group of each query name.

    As with metrics, a failure to write is logged and never reaches the stream.
    """

    def __init__(self, spark: SparkSession, path: str, copies: Mapping[str, tuple[int, str]]) -> None:
        self._spark, self._path, self._copies = spark, path, dict(copies)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        copy = self._copies.get(event.progress.name)
        if copy is None:
            return
        try:
            rows = offset_rows(json.loads(event.progress.json), *copy)
            if rows:
                self._spark.createDataFrame(rows, OFFSET_SNAPSHOT).coalesce(1).write.mode("append").parquet(self._path)
        except Exception:
            LOG.exception("offsets not written")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def read_offsets(spark: SparkSession, path: str) -> DataFrame:
    """The offsets that listeners wrote so far; none before the first."""
    try:
        return spark.read.schema(OFFSET_SNAPSHOT).parquet(path)
    except AnalysisException as error:
        if not not_written_yet(error):
            raise
        return spark.createDataFrame([], OFFSET_SNAPSHOT)


def on_ticks(snapshots: DataFrame, tick_ms: int, ticks: DataFrame) -> DataFrame:
    """Offsets as of common times, as the lag of two copies needs them: reports come at times of their own.

    ``ticks(observed_ms)`` are multiples of ``tick_ms``. At each, a partition has the highest offset reported until then;
    before its first report it has no row.
    """
    keys = ["pair_id", "group_id", "topic", "partition"]
    up = (F.ceil(F.col("observed_ms") / tick_ms) * tick_ms).cast("bigint")
    last = snapshots.groupBy(*keys, up.alias("observed_ms")).agg(F.max("offset").alias("offset"))
    # every partition is asked at every tick: partitions are few, ticks the asked ones only
    times = ticks.select("observed_ms").distinct().agg(F.collect_list("observed_ms").alias("times")).first()["times"]
    asked = last.select(*keys).distinct().select(*keys, F.explode(F.array(*[F.lit(t).cast("bigint") for t in sorted(times)])).alias("observed_ms")) if times else last.limit(0).drop("offset")
    both = last.unionByName(asked.withColumn("asked", F.lit(1)), allowMissingColumns=True).withColumn("asked", F.coalesce("asked", F.lit(0)))
    rows = running(both, keys, ["observed_ms", "asked"], Running("known", "max", F.col("offset")))
    return rows.filter((F.col("asked") == 1) & F.col("known").isNotNull()).select(*keys[:4], F.col("known").alias("offset"), "observed_ms")
