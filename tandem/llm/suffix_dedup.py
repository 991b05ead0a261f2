"""Removal of byte strings that occur earlier in the corpus, by fingerprints of sampled suffixes in four fixed rounds."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm import text as tx
from tandem.session import discard, stored

_U = np.uint64
_BASE = 0xA0761D6478BD642F
_BYTES = np.random.Generator(np.random.PCG64(23)).integers(1, 1 << 63, 256, dtype=np.uint64)
_PLACE = (1 << 20) - 1
# Positions of a run that round three ranks together.
BLOCK = 8
_arrays: dict[str, np.ndarray] = {}


def _powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _arrays:
        size = 2 * tx.BLOCK_BYTES
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            grown = np.full(size, base, np.uint64)
            grown[0] = 1
            _arrays[name] = np.cumprod(grown, dtype=np.uint64)
    return _arrays["up"][:count], _arrays["down"][:count]


class _Prints:
    """Fingerprints of any substring of a block."""

    def __init__(self, data: np.ndarray) -> None:
        up, self._down = _powers(len(data) + 1)
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[data] * up[:-1], out=self._sums[1:])

    def at(self, first: np.ndarray, last: np.ndarray, salt: int) -> np.ndarray:
        return tx.mix((self._sums[last] - self._sums[first]) * self._down[first], salt)

    def all(self, size: int, salt: int) -> np.ndarray:
        count = len(self._sums) - size
        return tx.mix((self._sums[size:] - self._sums[:count]) * self._down[:count], salt)


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` neighbours, by doubling."""
    have, out = 1, values
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def _blocks(places: np.ndarray, length: int) -> Iterator[tuple[int, int, int]]:
    """Byte ranges of a batch that are handled at once and the first text of each: whole texts, or parts of a long one."""
    for first, last in tx.groups(places, tx.BLOCK_BYTES // 2):
        begin, end = int(places[first]), int(places[last])
        if end - begin <= tx.BLOCK_BYTES // 2:
            yield first, begin, end
            continue
        step = tx.BLOCK_BYTES // 2
        for at in range(begin, max(end - length + 1, begin + 1), step):
            yield first, at, min(at + step + length - 1, end)


def _runs(data: np.ndarray, places: np.ndarray, length: int, size: int) -> Iterator[tuple]:
    """Runs of neighbouring start positions whose strings of ``length`` bytes share their sampled suffix.

    The sampled suffix of a string is the one, of those that start in it and still have ``size`` bytes in it, with the
    smallest hash of these bytes (leftmost on ties): it depends on the string alone, so equal strings sample alike.
    """
    width = length - size + 1
    for text, begin, end in _blocks(places, length):
        part = data[begin:end]
        if len(part) < length:
            continue
        prints = _Prints(part)
        keys = prints.all(size, 1)
        low = _sliding_min((keys & _U(~_PLACE & (1 << 64) - 1)) | np.arange(len(keys), dtype=np.uint64), width)
        anchor = (low & _U(_PLACE)).astype(np.int64)
        cuts = places[(places > begin) & (places < end)] - begin
        owner = np.zeros(len(part), np.int64)
        np.add.at(owner, cuts, 1)
        owner = np.cumsum(owner)
        start = np.arange(len(anchor))
        inside = owner[: len(anchor)] == owner[length - 1 : length - 1 + len(anchor)]
        new = np.ones(len(anchor), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | ~inside[:-1]
        lo = start[new & inside]
        if not len(lo):
            continue
        edge = np.flatnonzero(new | ~inside)
        after = np.searchsorted(edge, lo, "right")
        hi = np.where(after < len(edge), edge[np.minimum(after, len(edge) - 1)], len(anchor)) - 1
        a = anchor[lo]
        whole = prints.at(lo, hi + length, 2) + (a - lo).astype(np.uint64)
        first = np.searchsorted(places, begin + lo, "right") - 1
        # texts of no bytes share their place with the next one
        yield first, begin + lo - places[first], begin + hi - places[first], begin + a - places[first], keys[a], whole


def _items(docs: DataFrame, length: int, size: int) -> DataFrame:
    def rows(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, places = tx.buffers(batch.column("text"))
            ids, ties = batch.column("doc").to_numpy(zero_copy_only=False), batch.column("tie").to_numpy(zero_copy_only=False)
            for text, lo, hi, anchor, key, whole in _runs(data, places, length, size):
                yield pa.record_batch(
                    [pa.array(key.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(ids[text]), pa.array(ties[text]), pa.array(lo), pa.array(hi), pa.array(anchor)],
                    ["key", "whole", "doc", "tie", "lo", "hi", "anchor"],
                )

    return docs.select("doc", "tie", "text").mapInArrow(rows, "key bigint, whole bigint, doc bigint, tie bigint, lo bigint, hi bigint, anchor bigint")


def _flat(lists: pa.ListArray, *names: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """How many entries each list of structs has, and the named fields of all entries end to end; a null list has none."""
    sizes = np.diff(lists.offsets.to_numpy()) if not lists.null_count else np.array([len(x) if x.is_valid else 0 for x in lists], np.int64)
    entries = lists.flatten()
    return sizes, [entries.field(n).to_numpy(zero_copy_only=False) for n in names]


def _ranked(docs: DataFrame, rank) -> DataFrame:
    """Rows of ``rank(prints, begin, asked)`` for the spans asked of each text: a rank pair and the span it stands for.

    Short texts are fingerprinted together, a long one in blocks of the spans that start in it.
    """

    def parts(places: np.ndarray, owner: np.ndarray, spans: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        cuts = np.searchsorted(owner, np.arange(len(places)))
        for first, last in tx.groups(places, tx.BLOCK_BYTES // 2):
            own = spans[cuts[first] : cuts[last]]
            begin, end = int(places[first]), int(places[last])
            if end - begin <= tx.BLOCK_BYTES // 2:
                if len(own):
                    yield begin, end, own
                continue
            own = own[np.argsort(own[:, 0], kind="stable")]
            block = (own[:, 0] - begin) // (tx.BLOCK_BYTES // 2)
            for number in np.unique(block):
                here = own[block == number]
                yield int(here[0, 0]), int(here[:, 3].max()), here

    def rows(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, places = tx.buffers(batch.column("text"))
            sizes, columns = _flat(batch.column("asked"), "lo", "hi", "anchor", "end")
            ids, ties = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "tie"))
            owner = np.repeat(np.arange(len(sizes)), sizes)
            spans = np.stack(columns, axis=1).astype(np.int64) + places[owner][:, None]
            for begin, end, own in parts(places, owner, spans):
                left, right, *found = rank(_Prints(data[begin:end]), begin, own)
                text = np.searchsorted(places, found[0], "right") - 1
                out = [left.view(np.int64), right.view(np.int64), ids[text], ties[text], *(f - places[text] for f in found)]
                yield pa.record_batch([pa.array(c) for c in out], ["left", "right", "doc", "tie", "lo", "hi", "anchor"])

    schema = "left bigint, right bigint, doc bigint, tie bigint, lo bigint, hi bigint, anchor bigint"
    return docs.select("doc", "tie", "text", "asked").mapInArrow(rows, schema)


def _cores(docs: DataFrame, length: int, block: int) -> DataFrame:
    """Blocks of ``block`` positions of each asked run, at fixed distances from its sampled suffix, with the rank of the
    bytes that all strings of the block share: equal strings lie in blocks of equal rank."""

    def rank(prints: _Prints, begin: int, spans: np.ndarray) -> tuple:
        lo, hi, anchor = spans[:, 0], spans[:, 1], spans[:, 2]
        near, far = (anchor - hi) // block, (anchor - lo) // block
        count = far - near + 1
        run = np.repeat(np.arange(len(spans)), count)
        number = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count) + near[run]
        last = anchor[run] - number * block
        end = last - block + 1 + length
        first = last - begin
        left = prints.at(first, end - begin, 3) + number.astype(np.uint64)
        right = prints.at(anchor[run] - begin, end - begin, 4)
        return left, right, np.maximum(lo[run], last - block + 1), np.minimum(hi[run], last), anchor[run]

    return _ranked(docs, rank)


def _positions(docs: DataFrame, length: int) -> DataFrame:
    """The rank pair of every asked position: the ranks of its first and second half of ``length`` bytes."""
    half = length // 2

    def rank(prints: _Prints, begin: int, spans: np.ndarray) -> tuple:
        count = spans[:, 1] - spans[:, 0] + 1
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(spans[:, 0], count)
        first = at - begin
        return prints.at(first, first + half, 3), prints.at(first + half, first + length, 4), at, at, at

    return _ranked(docs, rank)


def _cut(docs: DataFrame) -> DataFrame:
    """What is left of each text after its spans are taken out."""

    def rows(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            sizes, (lows, ends) = _flat(batch.column("spans"), "lo", "end")
            cuts = np.concatenate([[0], np.cumsum(sizes)])
            for number, text in enumerate(batch.column("text")):
                data = memoryview(text.as_buffer() if text.is_valid else b"")
                kept, at, removed = hashlib.sha256(), 0, 0
                lo, end = lows[cuts[number] : cuts[number + 1]], ends[cuts[number] : cuts[number + 1]]
                order = np.argsort(lo, kind="stable")
                lo, reach = lo[order], np.maximum.accumulate(end[order])
                # a run begins where no span before it reaches
                begins = np.flatnonzero(np.append(len(lo) > 0, lo[1:] > reach[:-1]))
                for first, last in zip(lo[begins].tolist(), reach[np.append(begins, len(lo))[1:] - 1].tolist(), strict=True):
                    kept.update(data[at:first])
                    removed, at = removed + last - first, last
                kept.update(data[at:])
                out.append((len(data), removed, len(begins), kept.hexdigest()))
            columns = list(zip(*out, strict=True)) or [(), (), (), ()]
            yield pa.record_batch(
                [batch.column("doc"), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return docs.select("doc", "text", "spans").mapInArrow(rows, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def _shared_ranks(ranked: DataFrame) -> DataFrame:
    return ranked.groupBy("left", "right").agg(F.min(F.struct("doc", "tie", "lo")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")


def _asking(rows: DataFrame, spans: DataFrame, length: int) -> DataFrame:
    """Texts that have spans, with these as a list."""
    asked = F.collect_list(F.struct("lo", "hi", "anchor", (F.col("hi") + length).alias("end"))).alias("asked")
    texts = rows.select("doc", "tie", F.col("text").cast("binary").alias("text"))
    return texts.join(spans.groupBy("doc", "tie").agg(asked), ["doc", "tie"]).dropDuplicates(["doc", "tie"])


def repeated_spans(rows: DataFrame, length: int) -> DataFrame:
    """``(doc, tie, spans)``: the byte ranges of a text covered by strings of ``length`` bytes that also start earlier.

    Ranks are 64-bit names of byte strings, and only what shares its rank goes on to a longer offset. Round one ranks
    the sampled suffixes by their first bytes. Round two ranks whole runs of neighbouring positions: all but the first
    run of a rank are repeated. Round three ranks, of the first runs that still share a sampled suffix, blocks of
    positions by the bytes common to their strings. Round four ranks the positions that are left by the pair of ranks of
    their two halves, past the threshold.
    """
    size = max(1, length * 36 // 100)
    known = rows.filter("doc is not null")
    items = _items(known, length, size)
    shared = items.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    alive = stored(items.join(shared, "key", "left_semi"), "alive-suffixes")
    here = F.struct("doc", "tie", "lo")
    classes = alive.groupBy("key", "whole").agg(F.min(here).alias("first"), F.count(F.lit(1)).alias("n"))
    classes = stored(classes, "runs")
    several = classes.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    later = alive.join(classes.filter("n > 1").select("key", "whole", "first"), ["key", "whole"]).filter(here != F.col("first"))
    later = later.select("doc", "tie", "lo", (F.col("hi") + length).alias("end"))
    # the first run of a rank is in the aggregate itself, but for its extent, which all runs of the rank share
    opening = classes.join(several, "key", "left_semi").select("key", "whole", F.col("first.doc").alias("doc"), F.col("first.tie").alias("tie"), F.col("first.lo").alias("lo"))
    opening = alive.join(opening, ["key", "whole", "doc", "tie", "lo"], "left_semi").select("doc", "tie", "lo", "hi", "anchor")
    cores = stored(_cores(_asking(known, opening, length), length, BLOCK if size > BLOCK else 1), "cores")
    blocks = cores.join(_shared_ranks(cores), ["left", "right"]).select("doc", "tie", "lo", "hi", "anchor")
    ranked = _positions(_asking(known, blocks, length), length).select("left", "right", "doc", "tie", "lo")
    ranked = stored(ranked, "rank-pairs")
    discard(cores)
    again = ranked.join(_shared_ranks(ranked), ["left", "right"]).filter(here != F.col("first"))
    again = again.select("doc", "tie", "lo", (F.col("lo") + length).alias("end"))
    spans = later.unionByName(again).groupBy("doc", "tie").agg(F.collect_list(F.struct("lo", "end")).alias("spans"))
    spans = stored(spans, "spans")
    discard(alive, classes, ranked)
    return spans


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100) -> DataFrame:
    """Per row ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256`` after removing repeated bytes.

    A byte goes if a string of ``length`` bytes that covers it also starts earlier: in a document with a smaller id, or
    earlier in the same one. Texts are their UTF-8 bytes, null is empty, and matches never cross documents. Rows with
    one id and one text are one document, whose results are repeated; an id with different texts is several documents,
    in the order of a hash of the text. Nothing is removed from a row without an id, and it makes nothing repeated.
    A text shorter than ``length`` keeps everything; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    tx.small_batches(spark)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    twice = stored(rows.groupBy("doc").count().filter("count > 1 and doc is not null").select("doc", F.lit(True).alias("twice")), "repeated-ids")
    rows = rows.join(twice, "doc", "left").withColumn("tie", F.when(F.col("twice"), F.xxhash64("text")).otherwise(F.lit(0).cast("bigint")))
    rows = rows.select("doc", "tie", "text")
    spans = repeated_spans(rows, length)
    return _cut(rows.withColumn("text", F.col("text").cast("binary")).join(spans, ["doc", "tie"], "left"))
