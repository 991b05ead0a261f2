"""How document filters interact: what each removes in every order, with copies found in radix tries of whole texts."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.llm import text as tx
from tandem.llm.simhash import word_blocks
from tandem.session import discard, stored

# The filters and what fails them, fixed by contract.
FILTERS = "ABCDE"
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_CAPITAL_PERCENT = 3
_CAPITALS = bytes(range(65, 91))
_CONTINUED = bytes(range(0x80, 0xC0))
_JUNK = re.compile(rb"[#$%&*|]")
_BIT = {name: 1 << i for i, name in enumerate(FILTERS)}

# Bytes of text that one trie holds at most, but for the last group of texts with one prefix.
TRIE_BYTES = 16 << 20
# Texts under one prefix with more bytes than this get a longer prefix.
SHARD_BYTES = 64 << 20
PREFIX_CHARS = 32
PREFIX_GROWTH = 8
# Prefixes that may be found too heavy at one length, which bounds their broadcast.
MOST_HEAVY = 1_000_000


def failures(text: bytes) -> int:
    """The filters A to D that a text fails, as bits."""
    count, different = 0, set()
    for words in word_blocks(text):
        count += len(words)
        different.update(words)
    failed = _BIT["A"] if count < MIN_WORDS else 0
    if 100 * len(different) < MIN_DISTINCT_PERCENT * count:
        failed |= _BIT["B"]
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    if 100 * capitals > MAX_CAPITAL_PERCENT * len(text.translate(None, _CONTINUED)):
        failed |= _BIT["C"]
    return failed | (_BIT["D"] if _JUNK.search(text) else 0)


class RadixTrie:
    """A compressed trie of byte strings; a node is ``[label, children by first byte, terminal]``."""

    def __init__(self) -> None:
        self._root: list = [b"", {}, None]
        self.lowest: list[int] = []  # the smallest id at each terminal

    def insert(self, text: bytes, number: int) -> int:
        """Put a text in and give the number of its terminal, which keeps the smallest id."""
        node, at = self._root, 0
        while at < len(text):
            child = node[1].get(text[at])
            if child is None:
                child = [text[at:] if at else text, {}, None]
                node[1][text[at]] = child
                at = len(text)
            elif text.startswith(child[0], at):
                at += len(child[0])
            else:
                child = self._split(node, child, self._common(child[0], text, at))
                at += len(child[0])
            node = child
        if node[2] is None:
            node[2] = len(self.lowest)
            self.lowest.append(number)
        else:
            self.lowest[node[2]] = min(self.lowest[node[2]], number)
        return node[2]

    @staticmethod
    def _common(label: bytes, text: bytes, at: int) -> int:
        """How many first bytes of a label the text has at a place; at least one and not all."""
        same, differs = 1, min(len(label), len(text) - at + 1)
        while differs - same > 1:
            middle = (same + differs) // 2
            if text.startswith(label[same:middle], at + same):
                same = middle
            else:
                differs = middle
        return same

    @staticmethod
    def _split(parent: list, child: list, at: int) -> list:
        upper = [child[0][:at], {child[0][at]: child}, None]
        child[0] = child[0][at:]
        parent[1][upper[0][0]] = upper
        return upper

    def terminals(self) -> Iterator[tuple[bytes, int]]:
        """Every text and its smallest id, in order of the bytes."""
        open_nodes = [(self._root, b"")]
        while open_nodes:
            node, before = open_nodes.pop()
            text = before + node[0]
            if node[2] is not None:
                yield text, self.lowest[node[2]]
            open_nodes.extend((node[1][b], text) for b in sorted(node[1], reverse=True))


def _table(columns: dict, text: bool) -> pa.RecordBatch:
    types = {"doc": pa.int64(), "part": pa.string(), "mask": pa.int32(), "n": pa.int64()} | ({"text": pa.binary(), "size": pa.int64()} if text else {})
    return pa.record_batch([pa.array(columns[c], t) for c, t in types.items()], list(types))


def _decided_here(docs: DataFrame) -> DataFrame:
    """Masks of all rows, with copies inside a stretch of a task resolved by a trie before anything is moved.

    A row that is not the first of its text in its stretch is a copy for certain, and a row without an id never is;
    these come out with no text. Equal rows among the others come out once, with their number ``n``.
    """

    def stretch(held: list[tuple]) -> pa.RecordBatch:
        trie = RadixTrie()
        place = [trie.insert(text, doc) if doc is not None else None for doc, _, text in held]
        masks: dict[int, int] = {}
        out = {"doc": [], "part": [], "mask": [], "n": [], "text": [], "size": []}
        first: dict[tuple, int] = {}
        for (doc, part, text), at in zip(held, place, strict=True):
            mask = masks.get(at) if at is not None else None
            if mask is None:
                mask = failures(text)
                if at is not None:
                    masks[at] = mask
            is_first = at is not None and doc == trie.lowest[at]
            if is_first and (at, part) in first:
                out["n"][first[at, part]] += 1
                continue
            if is_first:
                first[at, part] = len(out["n"])
            copy = at is not None and not is_first
            values = (doc, part, mask | (_BIT["E"] if copy else 0), 1, text if is_first else None, len(text) if is_first else None)
            for column, value in zip(out.values(), values, strict=True):
                column.append(value)
        return _table(out, text=True)

    def rows(batches) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).fill_null(b"")
            for doc, part, text in zip(batch.column("doc").to_pylist(), batch.column("part").to_pylist(), texts, strict=True):
                held.append((doc, part, text.as_py()))
                size += len(held[-1][2]) + 64
                if size > TRIE_BYTES:
                    yield stretch(held)
                    held, size = [], 0
        if held:
            yield stretch(held)

    return docs.mapInArrow(rows, "doc bigint, part string, mask int, n bigint, text binary, size bigint")


def prefix_ranges(rows: DataFrame) -> DataFrame:
    """``rows`` with whole texts, range-partitioned and sorted by adaptive prefixes of their texts.

    A prefix has ``PREFIX_CHARS`` bytes at first. Where the texts that share it weigh more than ``SHARD_BYTES`` or than
    the share of one task, it grows by ``PREFIX_GROWTH`` until they do not or until it is the whole text. Columns
    ``first`` and ``prefix`` name it: its first bytes and a digest of all of it. Equal texts share their prefix, so they
    come to one place.
    """
    spark = rows.sparkSession
    total, longest = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("size"), F.lit(0))).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD_BYTES))
    limit = max(min(SHARD_BYTES, total // parts), total // MOST_HEAVY)
    length, named = PREFIX_CHARS, F.xxhash64(F.substring("text", 1, PREFIX_CHARS))
    out, under = rows.withColumn("prefix", named), rows.withColumn("prefix", named)
    while length < longest:
        heavy = under.groupBy("prefix").agg(F.sum("size").alias("bytes"), F.max("size").alias("longest"))
        heavy = stored(heavy.filter((F.col("bytes") > limit) & (F.col("longest") > length)).select("prefix", F.lit(True).alias("heavy")), "heavy-prefixes")
        if heavy.isEmpty():
            break
        length = length * PREFIX_GROWTH
        named = F.xxhash64(F.substring("text", 1, length))
        # at most MOST_HEAVY of them can hold more than the limit
        under = under.join(F.broadcast(heavy), "prefix", "left_semi").withColumn("prefix", named)
        out = out.join(F.broadcast(heavy), "prefix", "left").withColumn("prefix", F.when(F.col("heavy"), named).otherwise(F.col("prefix"))).drop("heavy")
    ranged = out.withColumn("first", F.substring("text", 1, PREFIX_CHARS)).repartitionByRange(parts, "first", "prefix")
    return ranged.sortWithinPartitions("first", "prefix")


def _decided_by_tries(ranged: DataFrame) -> DataFrame:
    """Masks with the copies flagged: whole texts go into tries, a stretch of complete prefixes at a time."""

    def flagged(held: list[tuple]) -> pa.RecordBatch:
        trie = RadixTrie()
        place = np.array([trie.insert(text, doc) for doc, _, _, _, text in held])
        docs = np.array([row[0] for row in held], np.int64)
        copies = docs > np.array(trie.lowest, np.int64)[place]
        masks = np.array([row[2] for row in held], np.int32) | np.where(copies, _BIT["E"], 0).astype(np.int32)
        return _table({"doc": docs, "part": [row[1] for row in held], "mask": masks, "n": [row[3] for row in held]}, text=False)

    def rows(batches) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            names = zip(batch.column("first").to_pylist(), batch.column("prefix").to_pylist(), strict=True)
            columns = (batch.column(c).to_pylist() for c in ("doc", "part", "mask", "n", "text"))
            for name, row in zip(names, zip(*columns, strict=True), strict=True):
                if size > TRIE_BYTES and name != last:
                    yield flagged(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4]) + 64
                last = name
        if held:
            yield flagged(held)

    columns = ranged.select("doc", "part", "mask", "n", "text", "first", "prefix")
    return columns.mapInArrow(rows, "doc bigint, part string, mask int, n bigint")


def failure_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``(part, mask, n, n_good, n_toxic)``: how many documents of a part fail exactly the filters of ``mask``.

    A row of ``docs`` is a document, repeated rows each count. A null text is empty, a null part the empty string. A
    row fails E if a row with a smaller id has the same text; a row without an id has no smaller id and is none, so it
    neither fails E nor makes others fail, and has no labels. A document with several labels counts as good or toxic
    if one of them says so. An empty table gives no rows; other columns are ignored.
    """
    tx.small_batches(docs.sparkSession)
    plain = docs.select(
        F.col(id_col).cast("bigint").alias("doc"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).cast("string").alias("text")
    )
    here = stored(_decided_here(plain), "failures")
    by_tries = _decided_by_tries(prefix_ranges(here.filter("text is not null")))
    rows = here.filter("text is null").select("doc", "part", "mask", "n").unionByName(by_tries)
    rows = stored(rows.groupBy("doc", "part", "mask").agg(F.sum("n").alias("n")), "masks")
    marks = labels.select(F.col(id_col).cast("bigint").alias("doc"), "quality", "toxic").filter("doc is not null")
    marks = marks.groupBy("doc").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("bad"))
    marked = rows.join(marks, "doc").groupBy("part", "mask").agg(
        F.sum(F.when(F.col("good") == 1, F.col("n")).otherwise(0)).alias("n_good"), F.sum(F.when(F.col("bad") == 1, F.col("n")).otherwise(0)).alias("n_toxic")
    )
    sums = rows.groupBy("part", "mask").agg(F.sum("n").alias("n")).join(marked, ["part", "mask"], "left").fillna(0, ["n_good", "n_toxic"])
    sums = stored(sums, "failure-counts")
    discard(here, rows)
    return sums


def interactions(counts: DataFrame) -> DataFrame:
    """What each filter removes at each step of each order, from the counts of ``failure_counts``; zeros included."""
    steps = []
    for order in permutations(FILTERS):
        for step, name in enumerate(order, 1):
            earlier = sum(_BIT[n] for n in order[: step - 1])
            steps.append(F.struct(F.lit("".join(order)).alias("filter_order"), F.lit(step).alias("step"), F.lit(_BIT[name]).alias("bit"), F.lit(earlier).alias("earlier")))
    rows = counts.select("*", F.explode(F.array(*steps)).alias("s")).select("*", "s.*")
    orders = len(steps) // len(FILTERS)
    fails = F.col("mask").bitwiseAND(F.col("bit")) != 0
    gone = F.col("mask").bitwiseAND(F.col("earlier")) != 0

    def total(condition: Column, value: str | Column = "n") -> Column:
        return F.sum(F.when(condition, F.col(value) if isinstance(value, str) else value).otherwise(F.lit(0).cast("bigint")))

    # of the orders, every failing filter is the first of the failing ones equally often
    share = F.col("n") * F.expr(f"{orders} div greatest(1, bit_count(mask))")
    return rows.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~gone).alias("kept"),
        total(fails & ~gone).alias("removed"),
        total(fails & gone).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(fails & ~gone, "n_good").alias("good_lost"),
        total(fails & ~gone, "n_toxic").alias("toxic_lost"),
        total(fails, share).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per part, order of the five filters and step; see ``failure_counts`` for awkward rows.

    Columns ``part``, ``filter_order``, ``step``, ``kept`` (after this step), ``removed`` (here), ``redundant`` (fails the
    filter but went earlier), ``unique_fails`` (fails it alone), ``good_lost``, ``toxic_lost`` (removed here, by label) and
    ``shapley`` (removed by the filter, summed over all orders).
    """
    return interactions(failure_counts(docs, labels, id_col, text_col, part_col))
