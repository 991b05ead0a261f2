"""Packing of tokenised documents into sequences by exact complements of lengths, then best fit."""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tandem.llm.text import SEPARATORS, hash_runs, small_batches, white_space_table
from tandem.session import stored

LENGTH = 4096
END_ID = 1
# Shares of a length whose documents are numbered apart, so that a frequent length is no single task.
SHARES = 256
# Words that a worker remembers, and characters that it handles at once.
CACHED_WORDS = 1_000_000
PART_CHARS = 500_000

_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


class WordTokens:
    """Token ids of texts, word by word with a bounded cache.

    The tokenizer splits a text at white space and between letters and punctuation (but for apostrophes) and then
    treats each part alone, so the ids of a text are those of its parts one after another. That is used for texts of
    the Latin blocks in normal form, where lower-casing is character by character in every library; any other text,
    and one with the text of a special token, goes to the tokenizer as it is. Parts are looked up by a 64-bit hash in an
    open table of arrays, all parts of many texts at once.
    """

    _PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-įı-ɏ]*+")
    _SLOTS = 1 << 21

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._special = tuple(t.content for t in self._tokenizer.get_added_tokens_decoder().values())
        kind = np.zeros(256, np.uint8)  # 1 for letters, 2 for punctuation that ends a word
        kind[97:123] = 1
        kind[[b for b in range(33, 127) if not chr(b).isalnum() and b != 39]] = 2
        self._kind, self._space = kind, np.isin(np.arange(256), SEPARATORS)
        self._clear()

    def _clear(self) -> None:
        self._known = 0
        self._key = np.zeros(self._SLOTS, np.uint64)
        self._first = np.full(self._SLOTS, -1, np.int64)
        self._size = np.zeros(self._SLOTS, np.int32)
        self._pool = np.zeros(1 << 20, np.uint32)
        self._filled = 0

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each hash: its own, or the free one where the search ended."""
        mask = np.int64(self._SLOTS - 1)
        slot = (hashes >> np.uint64(40)).astype(np.int64) & mask
        open_at = np.flatnonzero((self._first[slot] >= 0) & (self._key[slot] != hashes))
        while len(open_at):
            slot[open_at] = (slot[open_at] + 1) & mask
            here = slot[open_at]
            open_at = open_at[(self._first[here] >= 0) & (self._key[here] != hashes[open_at])]
        return slot

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        found = self._tokenizer.encode(words, is_pretokenized=True, add_special_tokens=False)
        ids = np.array(found.ids, np.uint32)
        ends = np.searchsorted(np.array(found.word_ids, np.int64), np.arange(len(words)), "right")
        while self._filled + len(ids) > len(self._pool):
            self._pool = np.concatenate([self._pool, np.zeros(len(self._pool), np.uint32)])
        self._pool[self._filled : self._filled + len(ids)] = ids
        begins = np.concatenate([[0], ends[:-1]])
        waiting = np.arange(len(hashes))
        while len(waiting):
            # of the new words that want one free slot, the first gets it and the others look on
            slot, winner = np.unique(self._find(hashes[waiting]), return_index=True)
            own = waiting[winner]
            self._key[slot], self._size[slot] = hashes[own], ends[own] - begins[own]
            self._first[slot] = self._filled + begins[own]
            waiting = np.delete(waiting, winner)
        self._filled += len(ids)
        self._known += len(words)

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts one after another, and how many each has."""
        parts = [t.lower().encode() for t in texts]
        places = np.zeros(len(parts) + 1, np.int64)
        np.cumsum([len(p) for p in parts], out=places[1:])
        raw = b"".join(parts)
        data = np.frombuffer(raw, np.uint8)
        space, kind = self._space[data], self._kind[data]
        flag = ~space
        begins = np.zeros(len(data) + 1, bool)
        begins[places[:-1]] = True
        flag[1:] &= space[:-1] | begins[1 : len(data)] | (kind[1:] + kind[:-1] == 3)
        starts = np.flatnonzero(flag)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        hashes = hash_runs(data, starts, white_space_table())
        slot = self._find(hashes)
        missing = np.flatnonzero(self._first[slot] < 0)
        if len(missing):
            new, at = np.unique(hashes[missing], return_index=True)
            at = missing[at]
            if self._known + len(new) > CACHED_WORDS:
                self._clear()
                new, at = np.unique(hashes, return_index=True)
            after = np.append(starts, len(data))
            self._learn(new, [raw[starts[i] : after[i + 1]].decode().strip() for i in at.tolist()])
            slot = self._find(hashes)
        size = self._size[slot].astype(np.int64)
        total = np.cumsum(size)
        ids = self._pool[np.repeat(self._first[slot] - (total - size), size) + np.arange(total[-1])]
        cuts = np.searchsorted(starts, places)
        return ids, np.diff(np.concatenate([[0], total])[cuts])

    def _is_plain(self, text: str) -> bool:
        if not self._PLAIN.fullmatch(text) or any(s in text for s in self._special):
            return False
        return text.isascii() or unicodedata.is_normalized("NFC", text)

    @staticmethod
    def _cut(text: str) -> Iterator[str]:
        """A long text in parts that begin at white space, which no id crosses."""
        at = 0
        while len(text) - at > PART_CHARS:
            end = max(text.rfind(" ", at + 1, at + PART_CHARS), text.rfind("\n", at + 1, at + PART_CHARS))
            if end < 0:
                end = min((e for e in (text.find(" ", at + PART_CHARS), text.find("\n", at + PART_CHARS)) if e > 0), default=len(text))
            yield text[at:end]
            at = end
        yield text[at:]

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        parts = [(number, part) for number, text in enumerate(texts) for part in self._cut(text)]
        out: list[list[np.ndarray]] = [[] for _ in texts]
        held: list[tuple[int, str]] = []
        chars = 0

        def flush() -> None:
            if held:
                ids, counts = self._plain([p for _, p in held])
                ends = np.cumsum(counts)
                for (number, _), n, end in zip(held, counts.tolist(), ends.tolist(), strict=True):
                    out[number].append(ids[end - n : end])
                held.clear()

        for number, part in parts:
            if self._is_plain(part):
                held.append((number, part))
                chars += len(part)
                if chars > PART_CHARS:
                    flush()
                    chars = 0
            else:
                # parts of one text must stay in order
                flush()
                out[number].append(np.array(self._tokenizer.encode(part, add_special_tokens=False).ids, np.uint32))
        flush()
        return [np.concatenate(p) if len(p) != 1 else p[0] for p in out]


_loaded: dict[str, WordTokens] = {}


def _tokens(path: str) -> WordTokens:
    """The tokenizer of this worker, kept from task to task."""
    if path not in _loaded:
        _loaded[path] = WordTokens(path)
    return _loaded[path]


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document as pieces of at most ``length`` ids, its last id being ``END_ID``; only longer ones are cut."""
    end = np.array([END_ID], np.uint32)

    def rows(batches) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(tokenizer)
        for batch in batches:
            out = []
            found = tokens([t or "" for t in batch.column("text").to_pylist()])
            for doc, ids in zip(batch.column("doc").to_pylist(), found, strict=True):
                ids = np.concatenate([ids, end]).astype("<u4")
                for piece, at in enumerate(range(0, len(ids), length)):
                    part = ids[at : at + length]
                    out.append((doc, piece, at, len(part), zlib.crc32(part.tobytes())))
            columns = list(zip(*out, strict=True)) or [()] * 5
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.record_batch(arrays, ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows_in = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).cast("string").alias("text"))
    return rows_in.mapInArrow(rows, _PIECES)


class _Stock:
    """How many pieces of each length are left, with the set of available lengths as the bits of a number."""

    def __init__(self, counts: dict[int, int], length: int) -> None:
        self.length, self.left = length, np.zeros(length + 1, np.int64)
        for size, n in counts.items():
            self.left[size] = n
        self.bits = sum(1 << size for size in counts if counts[size])
        self.mirror = sum(1 << (length - size) for size in counts if counts[size])

    def take(self, size: int, n: int) -> None:
        self.left[size] -= n
        if not self.left[size]:
            self.bits &= ~(1 << size)
            self.mirror &= ~(1 << (self.length - size))

    def largest(self, most: int) -> int:
        return (self.bits & ((1 << (most + 1)) - 1)).bit_length() - 1 if most > 0 else -1

    def _free(self, size: int, used: dict[int, int], n: int = 1) -> bool:
        return 0 < size <= self.length and self.left[size] - used.get(size, 0) >= n

    def pair(self, gap: int, used: dict[int, int]) -> tuple[int, int] | None:
        """Two lengths that sum to the gap, the larger as large as can be: one look at the index of all such sums."""
        sums = self.bits & (self.mirror >> (self.length - gap)) & ((1 << max(gap, 0)) - 1)
        while sums:
            a = sums.bit_length() - 1
            b = gap - a
            if b > a:
                break
            if self._free(a, used, 2 if a == b else 1) and self._free(b, used):
                return a, b
            sums ^= 1 << a
        return None

    def exact(self, gap: int, used: dict[int, int]) -> tuple[int, ...] | None:
        """One, two or three available lengths that fill a gap exactly."""
        if self._free(gap, used):
            return (gap,)
        found = self.pair(gap, used)
        if found:
            return found
        most = self.bits & ((1 << max(gap - 1, 0)) - 1)
        while most:
            a = most.bit_length() - 1
            if 3 * a < gap:
                break
            if self._free(a, used):
                rest = self.pair(gap - a, {**used, a: used.get(a, 0) + 1})
                if rest:
                    return (a, *rest)
            most ^= 1 << a
        return None


def plan(counts: dict[int, int], length: int = LENGTH) -> list[tuple[int, dict[int, int]]]:
    """Patterns of lengths and how many sequences follow each, for so many pieces of each length.

    The largest available length opens a sequence. A single, pair or triple that fills the gap exactly closes it, as
    often as the counts allow; where there is none, the best fitting length, the largest not above the gap, goes in
    and the search is repeated for what remains. Each pattern uses up a length or nearly so: there are not many
    more patterns than lengths, whatever the number of documents.
    """
    stock, patterns = _Stock(counts, length), []
    while stock.bits:
        used: dict[int, int] = {}
        gap = length
        while gap > 0:
            # a gap that three of the largest cannot fill needs no search
            top = stock.largest(gap)
            found = stock.exact(gap, used) if used and 3 * top >= gap else None
            if found:
                for size in found:
                    used[size] = used.get(size, 0) + 1
                gap = 0
                break
            while top > 0 and not stock._free(top, used):
                top = stock.largest(top - 1)
            if top <= 0:
                break
            used[top] = used.get(top, 0) + 1
            gap -= top
        times = min(int(stock.left[size]) // n for size, n in used.items())
        for size, n in used.items():
            stock.take(size, n * times)
        patterns.append((times, used))
    return patterns


def pack(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """``rows`` of pieces with ``sequence_id`` and ``offset``: no sequence exceeds ``length`` and none has gaps.

    Only the number of pieces per length, at most ``length`` numbers, reaches the driver. Every piece is numbered
    among those of its length, within shares of a length, and its number tells its place in the plan.
    """
    spark = rows.sparkSession
    share = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SHARES)).cast("int")
    rows = rows.withColumn("share", share)
    sizes = stored(rows.groupBy("length", "share").agg(F.count(F.lit(1)).alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots, sequence = [], 0
    taken: dict[int, int] = {}
    for times, used in plan(counts, length):
        offset = 0
        for size, n in sorted(used.items(), reverse=True):
            slots.append((size, taken.get(size, 0), sequence, n, offset))
            taken[size] = taken.get(size, 0) + n * times
            offset += size * n
        sequence += times
    table = np.array(sorted(slots) or [(0, 0, 0, 1, 0)], np.int64)
    shared = spark.sparkContext.broadcast(table)  # a few rows per pattern

    def place(batches) -> Iterator[pa.RecordBatch]:
        size, first, base, copies, offset = shared.value.T
        for batch in batches:
            own = batch.column("length").to_numpy(zero_copy_only=False)
            number = batch.column("number").to_numpy(zero_copy_only=False)
            at = np.zeros(len(own), np.int64)
            for value in np.unique(own):
                lo, hi = np.searchsorted(size, [value, value + 1])
                here = own == value
                at[here] = lo + np.searchsorted(first[lo:hi], number[here], "right") - 1
            step = number - first[at]
            columns = {c: batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")}
            columns["sequence_id"] = pa.array(base[at] + step // copies[at])
            columns["offset"] = pa.array(offset[at] + (step % copies[at]) * own)
            yield pa.RecordBatch.from_pydict(columns)

    before = F.sum("n").over(Window.partitionBy("length").orderBy("share").rowsBetween(Window.unboundedPreceding, -1))
    begins = sizes.select("length", "share", F.coalesce(before, F.lit(0)).alias("begin"))
    order = Window.partitionBy("length", "share").orderBy("doc_id", "piece", "ids_crc32")
    numbered = rows.withColumn("within", F.row_number().over(order)).join(begins, ["length", "share"])
    numbered = numbered.withColumn("number", F.col("begin") + F.col("within") - 1)
    schema = _PIECES + ", sequence_id bigint, offset bigint"
    return numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "number").mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer: str, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A null or empty text is the end id alone. Rows with one id are packed each, a null id stays null, an empty table
    gives no rows, and other columns are ignored. ``tokenizer`` is the path of the vocabulary file on every executor.
    """
    small_batches(docs.sparkSession)
    return pack(stored(pieces(docs, tokenizer, length, id_col, text_col), "pieces"), length)
