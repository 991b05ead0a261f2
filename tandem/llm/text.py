"""Vectorised hashing of words and shingles, for tasks that see Arrow batches of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

# Bytes handled at once in a task; a longer text is cut between words and its parts are joined again.
BLOCK_BYTES = 1 << 20
SEPARATORS = (9, 10, 11, 12, 13, 32)
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)


# ASCII bytes other than letters and digits
PUNCTUATION = tuple(b for b in range(128) if not chr(b).isalnum())


def _table(separators: tuple[int, ...]) -> np.ndarray:
    """A random value per byte; A-Z count as a-z and separators as nothing."""
    table = np.random.Generator(np.random.PCG64(11)).integers(1, 1 << 63, 256, dtype=np.uint64)
    table[65:91] = table[97:123]
    table[list(separators)] = 0
    return table


_TABLES = {s: (_table(s), np.isin(np.arange(256), s)) for s in (SEPARATORS, PUNCTUATION)}
_powers = np.ones(1, np.uint64)


def powers(count: int) -> np.ndarray:
    """Powers of the hash base modulo 2**64, kept between calls."""
    global _powers
    if len(_powers) < count:
        size = max(count, 2 * len(_powers), 4096)
        grown = np.full(size, _BASE, np.uint64)
        grown[0] = 1
        _powers = np.cumprod(grown, dtype=np.uint64)
    return _powers


def mix(values: np.ndarray, salt: int = 0) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values, another for each salt."""
    x = values ^ _U((salt * 0xD6E8FEB86659FD93 + 0x2545F4914F6CDD1D) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bound the rows of an Arrow batch, since a text may be long, and let finished jobs free their shuffle files."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a batch end to end, and where each begins; a null is empty."""
    texts = texts.cast(pa.binary()).fill_null(b"")
    if texts.offset:
        texts = pa.concat_arrays([texts])
    _, offsets, data = texts.buffers()
    places = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if data is None or places[-1] == places[0]:
        return np.zeros(0, np.uint8), places - places[0]
    return np.frombuffer(data, np.uint8)[places[0] : places[-1]], places - places[0]


def groups(places: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``limit`` bytes together; a longer text stands alone."""
    first = 0
    while first < len(places) - 1:
        last = int(np.searchsorted(places, places[first] + limit, "right")) - 1
        last = max(last, first + 1)
        yield first, last
        first = last


def hash_words(data: np.ndarray, places: np.ndarray, separators: tuple[int, ...] = SEPARATORS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number and first byte of every word of the given texts; words are runs without separators."""
    table, is_separator = _TABLES[separators]
    count = len(data)
    if count > 4 * BLOCK_BYTES and len(places) == 2:
        return _hash_long(data, separators)
    if not count:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    separator = is_separator[data]
    begins = np.zeros(count + 1, bool)
    begins[places[:-1]] = True
    flag = ~separator
    flag[1:] &= separator[:-1] | begins[1:count]
    starts = np.flatnonzero(flag)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), starts
    return hash_runs(data, starts, table), np.searchsorted(places, starts, "right") - 1, starts


def hash_runs(data: np.ndarray, starts: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A hash of each run of bytes from one start to the next; bytes that the table makes 0 count for nothing at its end."""
    lengths = np.diff(np.append(starts, len(data)))
    place = np.arange(starts[0], len(data)) - np.repeat(starts, lengths)
    values = table[data[starts[0] :]] * powers(int(lengths.max()))[place]
    return mix(np.add.reduceat(values, starts - starts[0]))


def white_space_table() -> np.ndarray:
    return _TABLES[SEPARATORS][0]


def _hash_long(data: np.ndarray, separators: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One long text in blocks that end between words."""
    is_separator = _TABLES[separators][1]
    hashes, starts, first = [], [], 0
    while first < len(data):
        last = min(first + BLOCK_BYTES, len(data))
        while last < len(data):
            gaps = np.flatnonzero(is_separator[data[last : last + BLOCK_BYTES]])
            if len(gaps):
                last += int(gaps[0])
                break
            last = min(last + BLOCK_BYTES, len(data))
        part = data[first:last]
        # two places would start the block search again for a block that is one long word
        found, _, begin = hash_words(part, np.array([0, len(part), len(part)]), separators)
        hashes.append(found)
        starts.append(begin + first)
        first = last
    joined = np.concatenate(hashes)
    return joined, np.zeros(len(joined), np.int64), np.concatenate(starts)


def shingles(words: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every run of ``size`` words; a shorter text is one run."""
    count = len(words)
    if not count:
        return words, owner
    total = np.bincount(owner)
    first = np.searchsorted(owner, np.arange(len(total)))
    run = mix(words, 1)
    out_hash, out_owner = [], []
    for step in range(1, size + 1):
        whole = np.flatnonzero(total == step) if step < size else np.zeros(0, np.int64)
        if len(whole):
            out_hash.append(run[first[whole]])
            out_owner.append(whole)
        if step < size:
            if len(run) <= 1:
                run = run[:0]
                break
            run = mix(run[:-1] * _U(3) + words[step:], 2)
    if len(run):
        inside = owner[: len(run)] == owner[size - 1 :][: len(run)]
        out_hash.append(run[inside])
        out_owner.append(owner[: len(run)][inside])
    hashes, owners = np.concatenate(out_hash), np.concatenate(out_owner)
    order = np.argsort(owners, kind="stable")
    return hashes[order], owners[order]


def shingle_sets(data: np.ndarray, places: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text in turn."""
    for first, last in groups(places):
        part = places[first : last + 1] - places[first]
        words, owner, _ = hash_words(data[places[first] : places[last]], part)
        hashes, owners = shingles(words, owner, size)
        cuts = np.searchsorted(owners, np.arange(last - first + 1))
        for at in range(last - first):
            yield np.unique(hashes[cuts[at] : cuts[at + 1]])


def lists(arrays: list[np.ndarray]) -> pa.ListArray:
    """An Arrow column of lists of unsigned values, as signed ones of that width."""
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(f"i{values.itemsize}")))
