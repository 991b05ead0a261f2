"""Repeated byte strings by prefix doubling over every suffix: ``suffix_dedup.repeated_spans`` by the plain method.

``suffix_dedup`` ranks only sampled suffixes, since this form moves many times its input (the README has figures). It
stays as a second computation of the same spans, for texts of moderate size and for comparison.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm import suffix_dedup
from tandem.llm import text as tx
from tandem.session import discard, stored

# Prefixes of up to so many bytes are named in the tasks that read the texts, without a round of their own.
NAMED_BYTES = 32
PLACE = ["doc", "tie", "at"]


def widths(length: int) -> list[int]:
    """Prefix lengths of the rounds, each at most twice the one before, the last one ``length``."""
    out = [length]
    while out[0] > NAMED_BYTES or len(out) < 2:
        out.insert(0, (out[0] + 1) // 2)
    return out


def _named(docs: DataFrame, size: int) -> DataFrame:
    """Every position with ``size`` bytes of its text ahead: the name of these bytes, and how many bytes are ahead in all."""

    def rows(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, places = tx.buffers(batch.column("text"))
            ids, ties = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "tie"))
            for _, begin, end in suffix_dedup._blocks(places, size):
                if end - begin < size:
                    continue
                names = suffix_dedup._Prints(data[begin:end]).all(size, 1)
                at = begin + np.arange(len(names))
                text = np.searchsorted(places, at, "right") - 1
                room = places[text + 1] - at
                fits = room >= size
                at, text, room = at[fits], text[fits], room[fits]
                columns = [ids[text], ties[text], (at - places[text]).astype(np.int64), room.astype(np.int64), names[fits].view(np.int64)]
                yield pa.record_batch([pa.array(c) for c in columns], [*PLACE, "room", "rank"])

    return docs.select("doc", "tie", "text").mapInArrow(rows, "doc bigint, tie bigint, at bigint, room bigint, rank bigint")


def repeated_spans(rows: DataFrame, length: int) -> DataFrame:
    """``(doc, tie, spans)`` of texts ``(doc, tie, text)``, as ``suffix_dedup.repeated_spans`` gives them.

    A round turns the ranks of prefixes of w bytes into those of n bytes, w < n <= 2w: the rank of a position is paired
    with that of the position n - w further on, equal pairs form a class, and the first position of a class is its
    new rank. Positions alone in their class are unique and go; a position whose partner went is unique, too. Ranks
    are written after each round and read by the next one. The first names are 64-bit hashes, so that strings are told
    apart by four of them at ``length`` 100. Texts without an id make nothing repeated; empty texts have no positions.
    """
    steps = widths(length)
    here = F.struct(*PLACE)
    known = rows.filter("doc is not null").select("doc", "tie", F.col("text").cast("binary").alias("text")).dropDuplicates(["doc", "tie"])
    named = _named(known, steps[0])
    shared = named.groupBy("rank").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("rank")
    alive = stored(named.join(shared, "rank", "left_semi"), "doubling")
    for width, wide in zip(steps, steps[1:]):
        partners = alive.select("doc", "tie", (F.col("at") - (wide - width)).alias("at"), F.col("rank").alias("further"))
        pairs = alive.filter(F.col("room") >= wide).join(partners, PLACE)
        classes = pairs.groupBy("rank", "further").agg(F.min(here).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        ranked = pairs.join(classes, ["rank", "further"]).select(*PLACE, "room", F.col("first").alias("rank"))
        before, alive = alive, stored(ranked, "doubling")
        discard(before)
    again = alive.filter(here != F.col("rank"))
    spans = again.groupBy("doc", "tie").agg(F.collect_list(F.struct(F.col("at").alias("lo"), (F.col("at") + length).alias("end"))).alias("spans"))
    spans = stored(spans, "doubling-spans")
    discard(alive)
    return spans
