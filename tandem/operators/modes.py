"""Write modes from control signals, and what they mean for the records written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.operators.scan import HotKeys, Running, find_hot_keys, running
from tandem.operators.small import join_small
from tandem.schemas import ACTIVE, BROADCAST, SHADOW

POSITION = ("offset", "trace_no")

# Only these two change a mode; all other signals, abort and heartbeat among them, leave it.
MODE_OF = {"PROMOTE": ACTIVE, "DEMOTE": SHADOW}


def signal_mode(signal_type: Column) -> Column:
    return F.when(signal_type == "PROMOTE", ACTIVE).when(signal_type == "DEMOTE", SHADOW)


def signals_delivered(signals: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per signal and app that receives it: the addressed app, or both apps of the pair."""
    wide = join_small(signals, pairs, ["pair_id"])
    apps = F.filter(F.array("app1", "app2"), lambda app: (F.col("target_app_id") == app) | (F.col("target_app_id") == BROADCAST))
    return wide.withColumn("app_id", F.explode(apps)).drop("app1", "app2")


def receivers(target: Column, app1: Column, app2: Column) -> Column:
    """The apps that a signal reaches: the addressed one, or both of its pair; a broadcast to an unknown pair reaches none."""
    return F.filter(F.when(target == BROADCAST, F.array(app1, app2)).otherwise(F.array(target)), lambda app: app.isNotNull())


def _mode_changes(signals: DataFrame, pairs: DataFrame) -> DataFrame:
    rows = join_small(signals.filter(F.col("signal_type").isin(*MODE_OF)), pairs.select("pair_id", "app1", "app2"), ["pair_id"], "left")
    app = F.explode(receivers(F.col("target_app_id"), F.col("app1"), F.col("app2"))).alias("app_id")
    return rows.select("pair_id", app, signal_mode(F.col("signal_type")).alias("mode"), "timestamp", *POSITION)


def mode_timeline(signals: DataFrame, pairs: DataFrame, initial: tuple[str, str] = (ACTIVE, SHADOW)) -> DataFrame:
    """Intervals of unchanged mode per app; the first starts at 0 and the last has no end.

    The start rows come before every signal (no position), and signals that repeat the mode are dropped.
    """
    roles = F.array(
        F.struct(F.col("app1").alias("app_id"), F.lit(initial[0]).alias("mode")),
        F.struct(F.col("app2").alias("app_id"), F.lit(initial[1]).alias("mode")),
    )
    start = pairs.select("pair_id", F.explode(roles).alias("r")).select("pair_id", "r.*", F.lit(0).cast("bigint").alias("timestamp"))
    keys = ["pair_id", "app_id"]
    changes = _mode_changes(signals, pairs).unionByName(start, allowMissingColumns=True)
    hot = find_hot_keys(changes, keys, POSITION[0])
    seen = running(changes, keys, POSITION, Running("previous", "lag", F.col("mode")), hot=hot)
    kept = seen.filter(F.col("previous").isNull() | (F.col("mode") != F.col("previous")))
    ended = running(kept, keys, POSITION, Running("valid_to_ms", "lead", F.col("timestamp")), hot=hot)
    return ended.select(*keys, "mode", F.col("timestamp").alias("valid_from_ms"), "valid_to_ms")


def _two_modes(signals: DataFrame, pairs: DataFrame) -> DataFrame:
    """Mode signals with one column per role of the pair."""
    rows = join_small(_mode_changes(signals, pairs), pairs, ["pair_id"])
    return rows.select(
        "pair_id", "timestamp", *POSITION,
        F.when(F.col("app_id") == F.col("app1"), F.col("mode")).alias("mode1"),
        F.when(F.col("app_id") == F.col("app2"), F.col("mode")).alias("mode2"),
    )


def modes_at_write(records: DataFrame, signals: DataFrame, pairs: DataFrame, at: str, seq: str) -> DataFrame:
    """Each record with the mode of both copies of its pair when it was written.

    Records and signals go through one scan per pair, for both copies at once; a signal at the very instant
    of a record counts. No range join, no row per copy.
    """
    marks = _two_modes(signals, pairs).withColumnRenamed("timestamp", "at_ms").withColumn("is_record", F.lit(0))
    rows = records.withColumns({"at_ms": F.col(at), "is_record": F.lit(1), POSITION[0]: F.col(seq)})
    both = rows.unionByName(marks, allowMissingColumns=True)
    seen = running(
        both, ["pair_id"], ["at_ms", "is_record", *POSITION],
        Running("app1_mode", "last", F.col("mode1")), Running("app2_mode", "last", F.col("mode2")),
    )
    return seen.filter("is_record = 1").select(
        *records.columns, F.coalesce("app1_mode", F.lit(ACTIVE)).alias("app1_mode"), F.coalesce("app2_mode", F.lit(SHADOW)).alias("app2_mode")
    )


def per_app(records: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per record and copy: ``app_id`` and its ``mode``."""
    wide = join_small(records, pairs, ["pair_id"])
    copies = F.array(
        F.struct(F.col("app1").alias("app_id"), F.col("app1_mode").alias("mode")),
        F.struct(F.col("app2").alias("app_id"), F.col("app2_mode").alias("mode")),
    )
    kept = [c for c in records.columns if c not in ("app1_mode", "app2_mode")]
    return wide.select(*kept, F.explode(copies).alias("c")).select(*kept, "c.*")


def gate_counts(per_app_rows: DataFrame) -> DataFrame:
    """Records written and dropped per app."""
    return per_app_rows.groupBy("pair_id", "app_id").agg(
        F.count_if(F.col("mode") == ACTIVE).alias("written"), F.count_if(F.col("mode") != ACTIVE).alias("dropped")
    )


def hot_writers(records: DataFrame, key: str, seq: str) -> HotKeys:
    return find_hot_keys(records.withColumn("_back", -F.col(seq)), [key], "_back")


def handoff_coverage(records: DataFrame, key: str, seq: str, hot: HotKeys | None = None) -> DataFrame:
    """Records that not exactly one copy wrote: gap or overlap.

    A gap matters only until the key's next written record, so that record is looked up, scanning each key
    backwards. ``hot`` may come from the records before their modes were looked up (see ``hot_writers``).
    """
    writers = (F.col("app1_mode") == ACTIVE).cast("int") + (F.col("app2_mode") == ACTIVE).cast("int")
    rows = records.withColumn("writers", writers).withColumn("_back", -F.col(seq))
    written = Running("next_written", "last", F.when(F.col("writers") > 0, F.col(seq)), before=True)
    seen = running(rows, [key], ["_back"], written, hot=hot)
    status = F.when(F.col("writers") == 0, "GAP").otherwise("OVERLAP")
    bad = seen.filter(F.col("writers") != 1).withColumn("status", status)
    return bad.withColumn("repaired_by", F.when(F.col("writers") == 0, F.col("next_written"))).drop("_back", "next_written")


def split_brain_intervals(signals: DataFrame, pairs: DataFrame) -> DataFrame:
    """Times when both copies of a pair were ACTIVE: a sweep over the signals instead of a range join."""
    marks = _two_modes(signals, pairs)
    hot = find_hot_keys(marks, ["pair_id"], POSITION[0])
    seen = running(marks, ["pair_id"], POSITION, Running("m1", "last", F.col("mode1")), Running("m2", "last", F.col("mode2")), hot=hot)
    both = (F.coalesce("m1", F.lit(ACTIVE)) == ACTIVE) & (F.coalesce("m2", F.lit(SHADOW)) == ACTIVE)
    seen = running(seen.withColumn("both", both), ["pair_id"], POSITION, Running("was", "lag", F.col("both")), hot=hot)
    turns = seen.filter(F.col("both") != F.coalesce("was", F.lit(False)))
    ended = running(turns, ["pair_id"], POSITION, Running("until_ms", "lead", F.col("timestamp")), hot=hot)
    found = ended.filter("both").select("pair_id", F.col("timestamp").alias("from_ms"), "until_ms")
    return found.filter(F.col("until_ms").isNull() | (F.col("from_ms") < F.col("until_ms")))


def signals_for_trace(log: DataFrame) -> DataFrame:
    """What the coordinator of a pair acts on: signals of the trace triggered last, untraced ones and heartbeats."""
    active = F.when(F.col("signal_type") == "TRIGGER", F.col("trace_id"))
    seen = running(log, ["pair_id"], POSITION, Running("active_trace", "last", active))
    passes = (
        (F.col("signal_type") == "HEARTBEAT")
        | F.col("trace_id").isNull()
        | F.col("active_trace").isNull()
        | (F.col("trace_id") == F.col("active_trace"))
    )
    return seen.filter(passes)
