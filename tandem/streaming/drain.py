"""Cutovers from control signals as streams, and the DRAINED_AT of each copy once it has read up to them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tandem.operators import cutover, modes
from tandem.operators.modes import POSITION
from tandem.streaming.packed import PACKED, ints, pack, pack_table, unpack
from tandem.streaming.runtime import use_state_store


def stream_cutovers(signals: DataFrame, order: Sequence[str] = POSITION) -> DataFrame:
    """Changes of the agreed offsets of each pair: set by a PREPARE with offsets, cleared (NULL) by an abort."""
    rows = cutover.moves_pending(signals).filter(F.col("signal_type") != "DEMOTE")
    place1, place2 = (F.col(c).cast("bigint") for c in order)
    return rows.select("pair_id", place1.alias("place1"), place2.alias("place2"), "trace_id", F.when(F.col("signal_type") == "PREPARE_HANDOFF", F.col("cutover_offsets")).alias("cutover_offsets"))


# kinds of rows in the union: signals come before positions of the same millisecond
_SIGNAL, _POSITION = 0, 1
LOG = (
    "pair_id INT, app_id STRING, at_ms BIGINT, kind INT, place1 BIGINT, place2 BIGINT, signal_type STRING, trace_id STRING, "
    "cutover_offsets MAP<INT,BIGINT>, partition INT, offset BIGINT"
)


def union_log(signals: DataFrame, positions: DataFrame, pairs: DataFrame, order: Sequence[str] = POSITION) -> DataFrame:
    """The two inputs as rows of one log: signals per copy that receives them, and offsets that a copy has read."""
    sent = modes.signals_delivered(cutover.moves_pending(signals), pairs)
    place1, place2 = (F.col(c).cast("bigint") for c in order)
    sent = sent.select(
        "pair_id", "app_id", F.col("timestamp").alias("at_ms"), F.lit(_SIGNAL).alias("kind"), place1.alias("place1"), place2.alias("place2"),
        "signal_type", "trace_id", "cutover_offsets", F.lit(None).cast("int").alias("partition"), F.lit(None).cast("bigint").alias("offset"),
    )
    none = F.lit(None)
    read = positions.select(
        "pair_id", "app_id", "at_ms", F.lit(_POSITION).alias("kind"), F.col("offset").alias("place1"), F.lit(0).cast("bigint").alias("place2"),
        none.cast("string").alias("signal_type"), none.cast("string").alias("trace_id"), none.cast("map<int,bigint>").alias("cutover_offsets"), "partition", "offset",
    )
    return sent.unionByName(read)


REACHED = f"pair_id INT, app_id STRING, {PACKED} BINARY"
# what is furthest where nothing has been read
_NONE, _LAST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


class PartitionReader(StatefulProcessor):
    """The furthest offset that a copy has read of one partition, and the target that is pending there.

    Gives a row when a target is reached: by a record, or by its PREPARE if it had been reached before. Rows are handled as
    arrays: the furthest offset is a running maximum, and where it reaches a target is a search in it.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("reader", "furthest BIGINT, target BIGINT, prepared1 BIGINT, prepared2 BIGINT")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        table = unpack(rows)
        # what has no time or place comes last, and an offset that is not known reaches nothing
        order = np.lexsort([ints(table, c, _LAST) for c in ("place2", "place1", "kind", "at_ms")])
        furthest, target, prepared1, prepared2 = self._state.get() or (int(_NONE), None, None, None)
        at, kind, place1, place2, offset = (ints(table, c, _NONE)[order] for c in ("at_ms", "kind", "place1", "place2", "offset"))
        far = np.maximum(np.maximum.accumulate(np.where(kind == _POSITION, offset, _NONE)), furthest)
        # the pending target, then each new one until the next
        begin = np.flatnonzero(kind == _SIGNAL)
        goal, goal1, goal2 = offset[begin], place1[begin], place2[begin]
        if target is not None:
            begin, goal, goal1, goal2 = (np.concatenate([[first], rest]) for first, rest in ((0, begin), (target, goal), (prepared1, goal1), (prepared2, goal2)))
        at_row = np.maximum(begin, np.searchsorted(far, goal))
        hit = at_row < np.append(begin[1:], len(order))[: len(begin)]
        waits = len(begin) > 0 and not hit[-1]
        self._state.update((int(far[-1]), *((int(goal[-1]), int(goal1[-1]), int(goal2[-1])) if waits else (None, None, None))))
        if hit.any():
            i = at_row[hit]
            reports = {
                "at_ms": at[i], "kind": kind[i], "place1": place1[i], "place2": place2[i], "partition": np.full(len(i), key[2], np.int32),
                "prepared1": goal1[hit], "prepared2": goal2[hit], "is_report": np.ones(len(i), np.int32),
            }
            yield pd.DataFrame({"pair_id": [key[0]], "app_id": [key[1]], PACKED: [pack_table(pa.table(reports))]})

    def close(self) -> None:
        pass


# offsets by partition as two arrays: states have no maps with numbers as keys
_PENDING = "trace_id STRING, prepared_ms BIGINT, place1 BIGINT, place2 BIGINT, partitions ARRAY<INT>, targets ARRAY<BIGINT>, reached ARRAY<INT>"
DRAINED = "pair_id INT, app_id STRING, trace_id STRING, prepared_ms BIGINT, drained_ms BIGINT, partitions ARRAY<INT>, targets ARRAY<BIGINT>"


class PendingCutover(StatefulProcessor):
    """The cutover that is pending for a copy and the partitions that have reached it; gives its DRAINED_AT once.

    What a partition reports counts only while the PREPARE it answers is pending. Rows are handled as arrays: each signal
    begins a group of reports, the held cutover the first one, and the report that completes the partitions of a group drains it.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("pending", _PENDING)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self._state.get()
        table = unpack(rows)
        # a partition that had read far enough before answers at the place of the PREPARE, right after it
        order = np.lexsort([ints(table, c) for c in ("prepared2", "prepared1", "is_report", "place2", "place1", "kind", "at_ms")])
        at, place1, place2, needs, partition, prepared1, prepared2 = (
            ints(table, c)[order] for c in ("at_ms", "place1", "place2", "needs", "partition", "prepared1", "prepared2")
        )
        report = ints(table, "is_report")[order] == 1

        def texts(column: str, at_rows: np.ndarray) -> list:
            return table[column].take(order[at_rows]).to_pylist() if len(at_rows) else []

        group, heads = np.cumsum(~report), np.flatnonzero(~report)
        # group 0 is the held cutover; a group that needs no partitions is an abort, or nothing
        was = list(held[6]) if held else []
        need = np.concatenate([[len(held[4]) if held else 0], needs[heads]])
        need1, need2 = (np.concatenate([[place or 0], rest[heads]]) for place, rest in ((held and held[2], place1), (held and held[3], place2)))
        answers = report & (need[group] > 0) & (prepared1 == need1[group]) & (prepared2 == need2[group]) & ~((group == 0) & np.isin(partition, was))
        i = np.flatnonzero(answers)
        # each partition counts once, by its first report
        i = i[~pd.DataFrame({"group": group[i], "partition": partition[i]}).duplicated().to_numpy()]
        number = np.arange(len(i)) - np.searchsorted(group[i], group[i]) + 1 + np.where(group[i] == 0, len(was), 0)
        done = i[number == need[group[i]]]
        if len(done):
            # the held cutover can only be drained first
            mine = int(group[done[0]] == 0)
            heads_done = heads[group[done[mine:]] - 1]
            first = ([held[0]], [held[1]], [held[4]], [held[5]]) if mine else ([], [], [], [])
            yield pd.DataFrame({
                "pair_id": key[0], "app_id": key[1], "trace_id": first[0] + texts("trace_id", heads_done),
                "prepared_ms": np.array(first[1] + at[heads_done].tolist(), np.int64), "drained_ms": at[done],
                "partitions": first[2] + texts("partitions", heads_done), "targets": first[3] + texts("targets", heads_done),
            })
        last = int(group[-1])
        if need[last] == 0 or last in group[done]:
            self._state.clear()
            return
        reached = sorted({int(p) for p in partition[i[group[i] == last]]} | set(was if last == 0 else []))
        if last == 0:
            self._state.update((*held[:6], reached))
        else:
            n = heads[-1:]
            (trace,), (partitions,), (targets,) = (texts(c, n) for c in ("trace_id", "partitions", "targets"))
            self._state.update((trace, *(int(v[n[0]]) for v in (at, place1, place2)), partitions, targets, reached))

    def close(self) -> None:
        pass


def stream_drained(log: DataFrame) -> DataFrame:
    """One DRAINED_AT per pending cutover and copy, as soon as the copy has read up to it on every partition.

    ``log`` has the rows of ``union_log``, whose micro-batches follow each other in time. Positions are followed per
    partition, and only what a partition reports comes together per copy. No watermark is set, so nothing is dropped.
    """
    use_state_store(log.sparkSession)
    is_signal = F.col("kind") == _SIGNAL
    place = ["at_ms", "kind", "place1", "place2"]
    targets = log.filter(is_signal & (F.col("signal_type") == "PREPARE_HANDOFF"))
    targets = targets.select("pair_id", "app_id", *place, F.explode("cutover_offsets").alias("partition", "offset"))
    read = log.filter(~is_signal).select("pair_id", "app_id", *place, "partition", "offset")
    keys = ["pair_id", "app_id"]
    by_partition = pack(targets.unionByName(read).select(*keys, "partition", *place, "offset"), [*keys, "partition"])
    reached = by_partition.groupBy(*keys, "partition").transformWithStateInPandas(PartitionReader(), REACHED, "Append", "None")
    offsets = F.when(F.col("signal_type") == "PREPARE_HANDOFF", F.col("cutover_offsets"))
    signals = log.filter(is_signal).select(
        *keys, *place, "trace_id", F.size(F.map_keys(offsets)).alias("needs"), F.map_keys(offsets).alias("partitions"), F.map_values(offsets).alias("targets")
    )
    rows = pack(signals, keys).unionByName(reached)
    out = rows.groupBy("pair_id", "app_id").transformWithStateInPandas(PendingCutover(), DRAINED, "Append", "None")
    return out.withColumn("cutover_offsets", F.map_from_arrays("partitions", "targets")).drop("partitions", "targets")
