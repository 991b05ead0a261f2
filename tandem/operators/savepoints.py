"""The register of state snapshots: locations, status versions, newest usable one, schema migration."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def current_status(versions: DataFrame, version: str = "changed_ms") -> DataFrame:
    """The newest version of each registered snapshot; a status update appends a version."""
    columns = [c for c in versions.columns if c not in ("savepoint_id", version)]
    # maps cannot be compared, but their sorted entries can: one row wins as a whole, also among equal versions
    order = [F.array_sort(F.map_entries(c)) if _is_map(versions, c) else F.col(c) for c in columns]
    row = F.struct(version, *columns)
    best = versions.groupBy("savepoint_id").agg(F.max_by(row, F.struct(F.col(version).alias("v"), *[c.alias(f"c{i}") for i, c in enumerate(order)])).alias("s"))
    return best.select("savepoint_id", "s.*")


def _is_map(df: DataFrame, name: str) -> bool:
    return dict(df.dtypes)[name].startswith("map")


def latest_completed(savepoints: DataFrame) -> DataFrame:
    """The newest completed snapshot per source job; the lower id wins among equals."""
    done = savepoints.filter(F.col("status") == "COMPLETED")
    position = F.struct(F.coalesce(-F.col("taken_at_ms"), F.lit(1 << 62)).alias("age"), F.col("savepoint_id"))
    best = done.groupBy("source_job_id").agg(F.min_by(F.struct("savepoint_id", "location", "taken_at_ms", "kafka_offsets"), position).alias("s"))
    return best.select("source_job_id", "s.*")


def by_id(savepoints: DataFrame, savepoint_id: str) -> DataFrame:
    return savepoints.filter(F.col("savepoint_id") == savepoint_id)


Step = Callable[[DataFrame], DataFrame]


class Migrations:
    """Steps from one state version to the next, applied as a chain to the rows that need them."""

    def __init__(self) -> None:
        self._steps: dict[int, Step] = {}

    def step(self, source: int, target: int) -> Callable[[Step], Step]:
        if target != source + 1:
            raise ValueError("a step leads to the next version")

        def register(fn: Step) -> Step:
            self._steps[source] = fn
            return fn

        return register

    def migrate(self, states: DataFrame, target: int, oldest: int = 1) -> DataFrame:
        """All rows at version ``target``. Each step sees only the rows of its version.

        The rows of every version are picked from the input by a filter, so no row is looked up or counted.
        """
        missing = [v for v in range(oldest, target) if v not in self._steps]
        if missing:
            raise ValueError(f"no migration step from version {missing[0]}")
        done = states.filter(F.col("state_version") == oldest)
        for version in range(oldest, target):
            done = self._steps[version](done).withColumn("state_version", F.lit(version + 1))
            done = done.unionByName(states.filter(F.col("state_version") == version + 1), allowMissingColumns=True)
        unknown = (F.col("state_version") < oldest) | (F.col("state_version") > target) | F.col("state_version").isNull()
        strange = states.filter(unknown)
        failed = F.raise_error(F.concat(F.lit("state version out of range: "), F.coalesce(F.col("state_version").cast("string"), F.lit("none"))))
        return done.unionByName(strange.withColumn("state_version", failed.cast("int")), allowMissingColumns=True)
