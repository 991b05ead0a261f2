"""The register of snapshots as a table: saved rows and status updates are appended versions."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.operators import savepoints
from tandem.schemas import SAVEPOINT, SAVEPOINT_STATUSES
from tandem.streaming.runtime import not_written_yet

VERSION = f"{SAVEPOINT}, changed_ms BIGINT"


class SavepointRegister:
    """Versions of snapshot rows under a path. Nothing is rewritten: the newest version of a snapshot counts.

    An update appends the whole row with its new status, so a reader never has to join versions. A version written
    twice changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._spark, self._path = spark, path

    def _versions(self) -> DataFrame:
        try:
            return self._spark.read.schema(VERSION).parquet(self._path)
        except AnalysisException as error:
            if not not_written_yet(error):
                raise
            return self._spark.createDataFrame([], VERSION)

    def _append(self, rows: DataFrame) -> None:
        columns = self._spark.createDataFrame([], VERSION).schema
        rows.select(*[F.col(c.name).cast(c.dataType) for c in columns]).write.mode("append").parquet(self._path)

    def save(self, rows: DataFrame, changed_ms: int | None = None) -> None:
        """Register snapshots, as of ``changed_ms`` or else of the time they were taken."""
        unknown = F.raise_error(F.concat(F.lit("unknown status "), F.coalesce("status", F.lit("none"))))
        status = F.when(F.col("status").isin(*SAVEPOINT_STATUSES), F.col("status")).otherwise(unknown.cast("string"))
        at = F.lit(changed_ms).cast("bigint") if changed_ms is not None else F.col("taken_at_ms")
        self._append(rows.withColumns({"status": status, "changed_ms": at}))

    def update_status(self, savepoint_id: str, status: str, changed_ms: int) -> bool:
        """Append the current row of a snapshot with another status; False if it is not registered."""
        if status not in SAVEPOINT_STATUSES:
            raise ValueError(f"unknown status {status}")
        rows = self.find(savepoint_id).withColumns({"status": F.lit(status), "changed_ms": F.lit(changed_ms).cast("bigint")})
        # one row, which is also read before its table grows
        held = rows.collect()
        if held:
            self._append(self._spark.createDataFrame(held, rows.schema))
        return bool(held)

    def current(self) -> DataFrame:
        return savepoints.current_status(self._versions())

    def find(self, savepoint_id: str) -> DataFrame:
        return savepoints.current_status(savepoints.by_id(self._versions(), savepoint_id))

    def latest_completed(self, source_job_id: str) -> DataFrame:
        return savepoints.latest_completed(savepoints.current_status(self._versions().filter(F.col("source_job_id") == source_job_id)))
