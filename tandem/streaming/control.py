"""Control signals as streams: modes, heartbeat silences and handoff progress."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tandem.operators import handoff, modes
from tandem.operators.cutover import has_offsets
from tandem.operators.modes import POSITION
from tandem.operators.small import join_small
from tandem.schemas import ACTIVE, BROADCAST, SHADOW
from tandem.streaming.packed import ints, pack, unpack
from tandem.streaming.runtime import use_state_store


# The order of rows of a topic; a control topic has one partition, or one per pair.
TOPIC_ORDER = ("partition", "offset")


def _in_order(rows) -> list[Row]:
    return sorted(rows, key=lambda r: (r.place1, r.place2))


def _places(order: Sequence[str]) -> list[Column]:
    return [F.col(c).cast("bigint").alias(f"place{i}") for i, c in enumerate(order, 1)]


def with_pair(signals: DataFrame, pairs: DataFrame) -> DataFrame:
    """Decoded topic rows with ``pair_id`` by a static table: from the addressed app, else the sending one, else the topic.

    ``pairs`` has ``pair_id, app1, app2`` and may name the ``topic`` of each pair. Rows of unknown pairs are left out.
    """
    named = [F.struct(F.col(c).alias("name"), F.lit(i).alias("as")) for i, c in ((0, "app1"), (0, "app2"), *([(1, "topic")] if "topic" in pairs.columns else []))]
    names = pairs.select("pair_id", F.explode(F.array(*named)).alias("n")).select("pair_id", "n.*")
    known, rows = [], signals
    for column, kind in (("target_app_id", 0), ("source_app_id", 0), ("topic", 1)):
        if column in signals.columns and (kind == 0 or "topic" in pairs.columns):
            own = names.filter(F.col("as") == kind).select(F.col("name").alias(column), F.col("pair_id").alias(f"_pair_{column}"))
            rows = join_small(rows, own, [column], "left")
            known.append(f"_pair_{column}")
    pair = F.coalesce(*known) if len(known) > 1 else F.col(known[0])
    return rows.withColumn("pair_id", pair).filter("pair_id is not null").select("pair_id", *signals.columns)


def mode_change(order: Sequence[str] = POSITION) -> str:
    return f"pair STRING, app_id STRING, mode STRING, since_ms BIGINT, {order[0]} BIGINT, {order[1]} BIGINT"


class ModeProcessor(StatefulProcessor):
    """The mode of one app; gives a row for each change. An app's share of a micro-batch is handled as arrays."""

    def __init__(self, order: Sequence[str] = POSITION) -> None:
        self._order = tuple(order)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._mode = handle.getValueState("mode", "mode STRING")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self._mode.get()
        table = unpack(rows)
        order = np.lexsort((ints(table, "place2"), ints(table, "place1")))
        at, place1, place2, active = (ints(table, c)[order] for c in ("timestamp", "place1", "place2", "active"))
        # the first copy of a pair starts as the writer
        before = int(held[0] == ACTIVE) if held else ints(table, "starts_active")[0]
        changed = active != np.concatenate([[before], active[:-1]])
        mode = np.where(active == 1, ACTIVE, SHADOW)
        if not held or held[0] != mode[-1]:
            self._mode.update((str(mode[-1]),))
        if changed.any():
            yield pd.DataFrame({
                "pair": key[0], "app_id": key[1], "mode": mode[changed], "since_ms": at[changed],
                self._order[0]: place1[changed], self._order[1]: place2[changed],
            })

    def close(self) -> None:
        pass


def stream_modes(signals: DataFrame, first_copy, pairs: DataFrame | None = None, order: Sequence[str] = POSITION) -> DataFrame:
    """Mode changes per app. ``first_copy`` is a condition on ``app_id`` that holds for apps starting ACTIVE.

    A broadcast signal reaches both apps of its pair, which a static table of ``pairs`` names. ``order`` names the two
    columns that order the signals of a pair: ``TOPIC_ORDER`` for rows as a topic has them.
    """
    use_state_store(signals.sparkSession)
    rows = signals.filter(F.col("signal_type").isin(*modes.MODE_OF))
    if pairs is None:
        rows = rows.filter(F.col("target_app_id") != BROADCAST).withColumn("app_id", F.col("target_app_id"))
    else:
        rows = rows.join(pairs.select("pair_id", "app1", "app2"), "pair_id", "left")
        rows = rows.withColumn("app_id", F.explode(modes.receivers(F.col("target_app_id"), F.col("app1"), F.col("app2"))))
    rows = rows.select(
        F.col("pair_id").cast("string").alias("pair"), "app_id", (modes.signal_mode(F.col("signal_type")) == ACTIVE).cast("int").alias("active"),
        "timestamp", *_places(order),
    )
    rows = rows.withColumn("starts_active", F.when(first_copy, 1).otherwise(0))
    # the pair is text on the way: arrays of numbers have no place for a missing one
    changes = pack(rows, ["pair", "app_id"]).groupBy("pair", "app_id").transformWithStateInPandas(ModeProcessor(order), mode_change(order), "Append", "None")
    return changes.select(F.col("pair").cast("int").alias("pair_id"), *changes.columns[1:])


SILENCE = "app_id STRING, last_beat_ms BIGINT, next_beat_ms BIGINT, silence_ms BIGINT, still_open BOOLEAN"


class HeartbeatWatchdog(StatefulProcessor):
    """Reports silences of one app longer than the timeout, once they end and, live, while they last.

    Live, a timer stands one timeout behind the arrival of the last beat by the clock of the executor, so a beat
    whose own clock is wrong hides nothing, and it is set again after each report. A stored log has no such clock:
    silences that end are reported here, and ``open_silences`` gives the others after the last row. Nothing but a
    report follows from it.
    """

    def __init__(self, timeout_ms: int, live: bool) -> None:
        self._timeout, self._live = timeout_ms, live

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._last = handle.getValueState("last", "beat_ms BIGINT, arrived_ms BIGINT, timer_ms BIGINT")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self._last.get()
        last, _, timer = held if held else (None, None, None)
        for beat in sorted(r.ts_ms for r in rows):
            if last is not None and beat - last > self._timeout:
                yield Row(app_id=key[0], last_beat_ms=last, next_beat_ms=beat, silence_ms=beat - last, still_open=False)
            last = beat if last is None else max(last, beat)
        arrived = None
        if self._live:
            if timer is not None:
                self._handle.deleteTimer(timer)
            arrived = timerValues.getCurrentProcessingTimeInMs()
            timer = arrived + self._timeout
            self._handle.registerTimer(timer)
        self._last.update((last, arrived, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        last, arrived, _ = self._last.get()
        now = timerValues.getCurrentProcessingTimeInMs()
        yield Row(app_id=key[0], last_beat_ms=last, next_beat_ms=None, silence_ms=now - arrived, still_open=True)
        timer = now + self._timeout
        self._handle.registerTimer(timer)
        self._last.update((last, arrived, timer))

    def close(self) -> None:
        pass


def stream_heartbeat_watchdog(beats: DataFrame, timeout_ms: int, stored_log: bool = False) -> DataFrame:
    """Silences as they happen; with ``stored_log`` only those that end, judged by the beats alone.

    No watermark is set, so no beat is dropped.
    """
    use_state_store(beats.sparkSession)
    time_mode = "None" if stored_log else "ProcessingTime"
    return beats.groupBy("app_id").transformWithState(HeartbeatWatchdog(timeout_ms, not stored_log), SILENCE, "Append", time_mode)


def _held(spark: SparkSession, checkpoint: str, variable: str) -> DataFrame:
    use_state_store(spark)
    spark.streams  # noqa: B018  the state reader needs the streaming manager to exist
    return spark.read.format("statestore").option("stateVarName", variable).load(checkpoint)


def open_silences(spark: SparkSession, checkpoint: str, timeout_ms: int) -> DataFrame:
    """Silences that a replayed log leaves open at its newest beat, from the state of its stream."""
    last = _held(spark, checkpoint, "last").select("key.app_id", F.col("value.beat_ms").alias("last_beat_ms"))
    end = last.agg(F.max("last_beat_ms").alias("end_ms")).first()["end_ms"]
    silence = F.lit(end).cast("bigint") - F.col("last_beat_ms")
    return last.filter(silence > timeout_ms).select(
        "app_id", "last_beat_ms", F.lit(None).cast("bigint").alias("next_beat_ms"), silence.alias("silence_ms"), F.lit(True).alias("still_open")
    )


PROGRESS = (
    "pair_id INT, trace_id STRING, state STRING, reason STRING, assumed BOOLEAN, triggered_ms BIGINT, prepared_ms BIGINT, "
    "drained_ms BIGINT, confirmed_ms BIGINT, finished_ms BIGINT"
)

# the states a trace can be in; the first and the last two end it
_TRIGGERED, _DRAINING, _PROMOTING, _ENDED = "WAITING_FOR_APP2_CATCHUP", "WAITING_FOR_APP1_DRAIN", "PROMOTING_APP2", "ENDED"


# How long an ended trace is remembered, so that late signals do not open it again.
KEEP_ENDED_MS = 7 * 86_400_000


class HandoffProgress(StatefulProcessor):
    """Follows one trace through its signals and time limits and reports how it ended. It commands nothing.

    Live, the deadline of a stage is set once, when the stage is entered; an ended trace is forgotten after
    ``KEEP_ENDED_MS``. In a stored log only its own times count, and ``timed_out_traces`` gives the traces whose time
    limit passed after their last signal.
    """

    def __init__(self, drain_ms: int, promote_ms: int, live: bool) -> None:
        self._limits = {_DRAINING: drain_ms, _PROMOTING: promote_ms}
        self._live = live

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._trace = handle.getValueState("trace", "stage STRING, triggered_ms BIGINT, prepared_ms BIGINT, drained_ms BIGINT, timer_ms BIGINT")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self._trace.get()
        stage, triggered, prepared, drained, timer = held if held else (_TRIGGERED, None, None, None, None)
        entered = stage
        for row in _in_order(rows):
            if triggered is None:
                triggered = row.timestamp
            if stage == _ENDED:
                continue
            since = drained if stage == _PROMOTING else prepared
            if stage in self._limits and row.timestamp > since + self._limits[stage]:
                # the time limit passed before this signal
                yield self._timed_out(key, stage, triggered, prepared, drained)
                stage = _ENDED
                continue
            outcome, reason, confirmed = None, None, None
            if row.signal_type == "HANDOFF_ABORT":
                outcome, reason = "HANDOFF_FAILED", row.reason or handoff.ABORTED
            elif row.signal_type == "SAVEPOINT_FAILED" and stage == _TRIGGERED:
                outcome, reason = "HANDOFF_FAILED", handoff.SAVEPOINT_FAILED
            elif row.signal_type == "PREPARE_HANDOFF" and stage == _TRIGGERED and row.has_offsets:
                stage, prepared = _DRAINING, row.timestamp
            elif row.signal_type == "DRAINED_AT" and stage == _DRAINING:
                stage, drained = _PROMOTING, row.timestamp
            elif row.signal_type == "TRANSFER_REFUSED" and stage == _PROMOTING:
                outcome, reason = "HANDOFF_FAILED", handoff.TRANSFER_REFUSED
            elif row.signal_type == "PROMOTED_CONFIRMED" and stage == _PROMOTING:
                outcome, confirmed = "HANDOFF_COMPLETE", row.timestamp
            if outcome:
                stage = _ENDED
                yield self._row(key, outcome, reason, False, triggered, prepared, drained, confirmed, row.timestamp)
        if self._live and stage != entered:
            timer = self._set_timer(stage, timer, timerValues)
        self._trace.update((stage, triggered, prepared, drained, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        stage, triggered, prepared, drained, _ = self._trace.get()
        if stage == _ENDED:
            self._trace.clear()
            return
        yield self._timed_out(key, stage, triggered, prepared, drained)
        timer = self._set_timer(_ENDED, None, timerValues)
        self._trace.update((_ENDED, triggered, prepared, drained, timer))

    def _set_timer(self, stage, old, timerValues) -> int:
        if old is not None:
            self._handle.deleteTimer(old)
        timer = timerValues.getCurrentProcessingTimeInMs() + self._limits.get(stage, KEEP_ENDED_MS)
        self._handle.registerTimer(timer)
        return timer

    def _timed_out(self, key, stage, triggered, prepared, drained) -> Row:
        if stage == _PROMOTING:
            return self._row(key, "HANDOFF_COMPLETE", None, True, triggered, prepared, drained, None, drained + self._limits[stage])
        return self._row(key, "HANDOFF_FAILED", handoff.DRAIN_TIMEOUT, False, triggered, prepared, None, None, prepared + self._limits[stage])

    @staticmethod
    def _row(key, state, reason, assumed, triggered, prepared, drained, confirmed, finished) -> Row:
        return Row(
            pair_id=key[0], trace_id=key[1], state=state, reason=reason, assumed=assumed, triggered_ms=triggered,
            prepared_ms=prepared, drained_ms=drained, confirmed_ms=confirmed, finished_ms=finished,
        )

    def close(self) -> None:
        pass


def stream_handoff_progress(
    log: DataFrame, drain_ms: int = handoff.DRAIN_TIMEOUT_MS, promote_ms: int = handoff.PROMOTE_TIMEOUT_MS, stored_log: bool = False,
    order: Sequence[str] = POSITION,
) -> DataFrame:
    """One row per trace when it ends, by a signal or by its time limit; no watermark, so no signal is dropped.

    With ``stored_log`` a time limit counts once a later signal of its trace shows it.
    """
    use_state_store(log.sparkSession)
    rows = log.filter(F.col("trace_id").isNotNull()).select(
        "pair_id", "trace_id", *_places(order), "signal_type", "timestamp", "reason", has_offsets(F.col("cutover_offsets")).alias("has_offsets")
    )
    processor = HandoffProgress(drain_ms, promote_ms, not stored_log)
    return rows.groupBy("pair_id", "trace_id").transformWithState(processor, PROGRESS, "Append", "None" if stored_log else "ProcessingTime")


def timed_out_traces(
    spark: SparkSession, checkpoint: str, end_ms: int | None, drain_ms: int = handoff.DRAIN_TIMEOUT_MS, promote_ms: int = handoff.PROMOTE_TIMEOUT_MS
) -> DataFrame:
    """Traces of a replayed log whose time limit passed between their last signal and ``end_ms``, the end of the log."""
    held = _held(spark, checkpoint, "trace").select("key.*", "value.*").filter(F.col("stage").isin(_DRAINING, _PROMOTING))
    promoting = F.col("stage") == _PROMOTING
    finished = F.when(promoting, F.col("drained_ms") + promote_ms).otherwise(F.col("prepared_ms") + drain_ms)
    return held.filter(finished <= F.lit(end_ms).cast("bigint")).select(
        "pair_id", "trace_id", F.when(promoting, "HANDOFF_COMPLETE").otherwise("HANDOFF_FAILED").alias("state"),
        F.when(~promoting, handoff.DRAIN_TIMEOUT).alias("reason"), promoting.alias("assumed"), "triggered_ms", "prepared_ms",
        F.when(promoting, F.col("drained_ms")).alias("drained_ms"), F.lit(None).cast("bigint").alias("confirmed_ms"), finished.alias("finished_ms"),
    )


def _followed(steps: Column, drain_ms: int, promote_ms: int) -> Column:
    """What ``HandoffProgress`` holds and reports after the steps of a trace, as one fold over them in their order."""
    none = F.lit(None)
    names = ("stage", "state", "reason", "assumed", "prepared_ms", "drained_ms", "confirmed_ms", "finished_ms")
    types = ("string", "string", "string", "boolean", "bigint", "bigint", "bigint", "bigint")

    def held(*values: Column) -> Column:
        return F.struct(*[v.cast(kind).alias(name) for v, kind, name in zip(values, types, names, strict=True)])

    def step(was: Column, row: Column) -> Column:
        at, kind = row["timestamp"], row["signal_type"]
        triggered, draining, promoting = (was["stage"] == stage for stage in (_TRIGGERED, _DRAINING, _PROMOTING))
        prepared, drained = was["prepared_ms"], was["drained_ms"]
        reason = F.coalesce(F.nullif(row["reason"], F.lit("")), F.lit(handoff.ABORTED))

        def failed(why: Column) -> Column:
            return held(F.lit(_ENDED), F.lit("HANDOFF_FAILED"), why, F.lit(False), prepared, drained, none, at)

        return (
            F.when(was["stage"] == _ENDED, was)
            # the time limit passed before this signal
            .when(promoting & (at > drained + promote_ms), held(F.lit(_ENDED), F.lit("HANDOFF_COMPLETE"), none, F.lit(True), prepared, drained, none, drained + promote_ms))
            .when(draining & (at > prepared + drain_ms), held(F.lit(_ENDED), F.lit("HANDOFF_FAILED"), F.lit(handoff.DRAIN_TIMEOUT), F.lit(False), prepared, none, none, prepared + drain_ms))
            .when(kind == "HANDOFF_ABORT", failed(reason))
            .when((kind == "SAVEPOINT_FAILED") & triggered, failed(F.lit(handoff.SAVEPOINT_FAILED)))
            .when((kind == "PREPARE_HANDOFF") & triggered & row["has_offsets"], held(F.lit(_DRAINING), none, none, F.lit(False), at, none, none, none))
            .when((kind == "DRAINED_AT") & draining, held(F.lit(_PROMOTING), none, none, F.lit(False), prepared, at, none, none))
            .when((kind == "TRANSFER_REFUSED") & promoting, failed(F.lit(handoff.TRANSFER_REFUSED)))
            .when((kind == "PROMOTED_CONFIRMED") & promoting, held(F.lit(_ENDED), F.lit("HANDOFF_COMPLETE"), none, F.lit(False), prepared, drained, at, at))
            .otherwise(was)
        )

    return F.aggregate(steps, held(F.lit(_TRIGGERED), none, none, F.lit(False), none, none, none, none), step)


class ProgressReplay:
    """``stream_handoff_progress`` of a stored log for ``foreachBatch``, without Python on the way of a trace.

    The stream collects the steps of each trace in the state store; a batch follows those of the traces it touched from
    their begin and writes what they are at under its own number, so a replayed batch rewrites the same files. The log
    must come in its order, as ``runtime.stage`` gives it.
    """

    def __init__(self, folder: str, drain_ms: int = handoff.DRAIN_TIMEOUT_MS, promote_ms: int = handoff.PROMOTE_TIMEOUT_MS) -> None:
        self._path, self._drain, self._promote = f"{folder}/traces", drain_ms, promote_ms

    def steps(self, log: DataFrame, order: Sequence[str] = POSITION) -> DataFrame:
        """The steps of each trace so far; runs in update mode."""
        use_state_store(log.sparkSession)
        rows = log.filter(F.col("trace_id").isNotNull())
        step = F.struct(*_places(order), "timestamp", "signal_type", "reason", has_offsets(F.col("cutover_offsets")).alias("has_offsets"))
        return rows.groupBy("pair_id", "trace_id").agg(F.collect_list(step).alias("steps"))

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        ordered = batch.select("pair_id", "trace_id", F.array_sort("steps").alias("steps"))
        at = _followed(F.col("steps"), self._drain, self._promote)
        rows = ordered.select("pair_id", "trace_id", F.col("steps")[0]["timestamp"].alias("triggered_ms"), at.alias("at")).select("pair_id", "trace_id", "triggered_ms", "at.*")
        rows.filter(F.col("stage") != _TRIGGERED).write.mode("overwrite").parquet(f"{self._path}/batch={batch_id}")

    def ended(self, spark: SparkSession, end_ms: int | None) -> DataFrame:
        """One row per trace that a signal ended, or whose time limit passed up to ``end_ms``, the end of the log."""
        columns = [c.split()[0] for c in PROGRESS.split(", ")]
        written = spark.read.schema(f"{PROGRESS}, stage STRING, batch BIGINT").parquet(self._path)
        own = F.struct(*[c for c in written.columns if c not in ("pair_id", "trace_id", "batch")])
        # the first end of a trace stands, and one without an end is where it came to last
        first_end = F.min_by(own, F.when(F.col("stage") == _ENDED, F.col("batch")))
        last = written.groupBy("pair_id", "trace_id").agg(F.coalesce(first_end, F.max_by(own, "batch")).alias("s")).select("pair_id", "trace_id", "s.*")
        open_, promoting = F.col("stage") != _ENDED, F.col("stage") == _PROMOTING
        limit = F.when(promoting, F.col("drained_ms") + self._promote).otherwise(F.col("prepared_ms") + self._drain)
        settled = last.filter(~open_ | (limit <= F.lit(end_ms).cast("bigint"))).withColumns({
            "state": F.when(~open_, F.col("state")).when(promoting, "HANDOFF_COMPLETE").otherwise("HANDOFF_FAILED"),
            "reason": F.when(~open_, F.col("reason")).when(~promoting, handoff.DRAIN_TIMEOUT),
            "assumed": F.when(open_, promoting).otherwise(F.col("assumed")),
            "finished_ms": F.when(open_, limit).otherwise(F.col("finished_ms")),
        })
        return settled.select(*columns)
