"""Near duplicates by SimHash: fingerprints are split into blocks that close pairs must share, then compared."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.llm import text as tx
from tandem.llm.graph import components
from tandem.llm.skew import join_hot
from tandem.session import discard, stored

SEED = 42
BITS = 64
# Members of a bucket that are compared pair by pair; a larger bucket meets through neighbouring fingerprints.
PAIRED = 64
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def word_blocks(text: bytes, limit: int = tx.BLOCK_BYTES) -> Iterator[list[bytes]]:
    """The words of a text in order, a bounded stretch at a time; stretches end between words."""
    first = 0
    while first < len(text):
        gap = _SPACE.search(text, first + limit) if first + limit < len(text) else None
        last = gap.start() if gap else len(text)
        yield text[first:last].split()
        first = last


def fingerprint(text: bytes, size: int = 3) -> bytes:
    """The SimHash of a text as 8 bytes, highest bit first.

    A bit is set if over half of the hashes of all shingles have it, repeats included. A text of fewer than ``size``
    words is one shingle; one without words has no bit set.
    """
    ones, count, tail = np.zeros(BITS, np.int64), 0, []
    digest = xxhash.xxh64_digest
    for words in word_blocks(text.lower()):
        words = tail + words
        tail = words[-(size - 1) :] if size > 1 else []
        shingles = zip(*(words[i:] for i in range(size)), strict=False)
        hashes = b"".join([digest(b" ".join(s), SEED) for s in shingles])
        if hashes:
            count += len(hashes) // 8
            ones += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    if not count:
        return digest(b" ".join(tail), SEED) if tail else bytes(8)
    return np.packbits(2 * ones > count).tobytes()


def _fingerprints(docs: DataFrame, size: int) -> DataFrame:
    """``(doc, print)``, the fingerprint as a signed 64-bit number."""

    def rows(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).fill_null(b"")
            prints = b"".join([fingerprint(t.as_py(), size) for t in texts])
            yield pa.record_batch([batch.column("doc"), pa.array(np.frombuffer(prints, ">i8").astype(np.int64))], ["doc", "print"])

    return docs.mapInArrow(rows, "doc bigint, print bigint")


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def tables(count: int, distance: int) -> list[int]:
    """Masks of the shared blocks, one per table, for ``count`` fingerprints.

    Of b blocks at most ``distance`` can differ, so a close pair agrees on some b - ``distance`` of them. The fewest
    blocks are taken whose keys have room for all fingerprints: chance then puts few into one bucket.
    """
    blocks = distance + 1
    while blocks < BITS and count >> (BITS * (blocks - distance) // blocks):
        blocks += 1
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    masks = [(1 << cuts[i + 1]) - (1 << cuts[i]) for i in range(blocks)]
    return [sum(kept) for kept in combinations(masks, blocks - distance)]


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _paired(members: DataFrame, distance: int) -> DataFrame:
    """Links within buckets: all members of a bucket meet, and the whole fingerprints are compared."""
    left = members.select("table", "key", F.col("print").alias("x"), F.col("rep").alias("a"))
    right = members.select("table", "key", F.col("print").alias("y"), F.col("rep").alias("b"))
    met = left.join(right, ["table", "key"]).filter(F.col("x") < F.col("y"))
    return met.filter(_distance(F.col("x"), F.col("y")) <= distance).select("a", "b")


def _around(prints: DataFrame, distance: int) -> DataFrame:
    """Links among many fingerprints that crowd together, without comparing all pairs.

    Two fingerprints differ in at most two bits if and only if some value lies within one bit of both. So each one
    visits itself and its 64 neighbours, and those that meet at a value, at most 65, are linked to the first of them.
    """
    if distance != 2:
        raise ValueError("crowded buckets are implemented for a distance of 2")
    flips = F.array(*[F.lit(0).cast("bigint"), *[F.lit(_signed(1 << i)) for i in range(BITS)]])
    visits = prints.select("print", "rep", F.explode(F.transform(flips, lambda f: F.col("print").bitwiseXOR(f))).alias("at"))
    met = visits.groupBy("at").agg(F.min("rep").alias("a"), F.collect_set(F.struct("print", "rep")).alias("members")).filter(F.size("members") > 1)
    links = met.select("a", F.explode("members").alias("m")).select("a", F.col("m.rep").alias("b"))
    return links.filter("a <> b").distinct()


def links(classes: DataFrame, total: int, distance: int = 2) -> DataFrame:
    """``(a, b)``: representatives of fingerprints at most ``distance`` bits apart, enough of them to connect all such pairs.

    ``classes(print, rep)`` holds ``total`` different fingerprints. Buckets of up to ``PAIRED`` members are joined on
    their shared blocks; a fingerprint in a larger bucket meets others around its neighbours.
    """
    masks = tables(total, distance)
    keyed = F.array(*[F.struct(F.lit(i).alias("table"), F.col("print").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)])
    entries = classes.select("print", "rep", F.explode(keyed).alias("e")).select("print", "rep", "e.table", "e.key")
    buckets = stored(entries.groupBy("table", "key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1"), "buckets")
    members = stored(join_hot(entries, buckets, ["table", "key"], "members", total * len(masks)), "bucket-members")
    crowded = members.filter(F.col("members") > PAIRED).select("print", "rep").distinct()
    found = _paired(members.filter(F.col("members") <= PAIRED), distance).unionByName(_around(crowded, distance))
    found = stored(found, "simhash-links")
    discard(buckets, members)
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, distance: int = 2) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``fingerprint`` and ``component_id``, the smallest id reachable by links.

    Two documents link when their fingerprints differ in at most ``distance`` bits. Words are runs without white space,
    A-Z lower-cased, and whole texts count. A null or empty text, or one of white space, has the fingerprint zero
    and links like any other. Equal rows are reported alike. A row without an id has a fingerprint but no component, and
    links nothing. An id with several texts is one document with several fingerprints: a link of any of them
    counts. An empty table gives no rows; other columns are ignored.
    """
    tx.small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).cast("string").alias("text"))
    prints = stored(_fingerprints(rows, size), "fingerprints")
    known = prints.filter("doc is not null")
    classes = stored(known.groupBy("print").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("n")), "classes")
    found = links(classes.select("print", "rep"), classes.count(), distance)
    # the fingerprints of one id belong together
    several = known.groupBy("doc").agg(F.min("print").alias("lo"), F.max("print").alias("hi")).filter("lo <> hi").select("doc")
    own = known.join(several, "doc", "left_semi").join(classes.select("print", "rep"), "print").select(F.col("doc").alias("a"), F.col("rep").alias("b"))
    groups = components(found.unionByName(own)).withColumnRenamed("node", "rep")
    named = classes.join(groups, "rep", "left").select("print", "n", F.coalesce("component", "rep").alias("component"))
    named = stored(named, "named-fingerprints")
    out = join_hot(known, named, ["print"], "n", known.count()).select("doc", "print", "component")
    out = out.unionByName(prints.filter("doc is null").withColumn("component", F.lit(None).cast("bigint")))
    return out.select(F.col("doc").alias("doc_id"), F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
