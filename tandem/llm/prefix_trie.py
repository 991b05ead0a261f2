"""Prefix tree of conversations: double-array tries per shard of prefixes, merged where shards share nodes."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm import text as tx
from tandem.session import discard, stored

BLOCK = 100
MOST_SHARED = 5
# Bytes of a turn's digest.
KEY = 16
# Turns that one trie should hold; a prefix with more is cut further down.
SHARD_TURNS = 250_000
# Prefixes of one depth that may be found too heavy for a shard, which bounds what is broadcast of them.
MOST_HEAVY = 20_000
# Rows of shared nodes up to which they are broadcast.
MOST_BROADCAST = 500_000
# Sequences a task remembers having sent on.
REMEMBERED = 50_000
# Places tried for the children of a node before they go to the end of the array.
TRIED = 2048
_EMPTY = hashlib.sha256().hexdigest()


class DoubleArray:
    """A trie over dense codes: the child of node ``s`` by code ``c`` is ``t = BASE[s] + c`` if ``CHECK[t]`` is ``s``."""

    def __init__(self) -> None:
        self.base, self.check = np.zeros(1024, np.int64), np.full(1024, -1, np.int64)
        self.check[0] = np.iinfo(np.int64).max  # the root is taken, and the child of no node
        self.top, self._first = 1, 1

    def _reserve(self, size: int) -> None:
        if size > len(self.check):
            grown = max(size, 2 * len(self.check)) - len(self.check)
            self.base = np.append(self.base, np.zeros(grown, np.int64))
            self.check = np.append(self.check, np.full(grown, -1, np.int64))

    def _place(self, steps: np.ndarray) -> int:
        """A free slot such that all slots ``steps`` after it are free, too."""
        if len(steps) <= 64:
            self._reserve(self.top + TRIED + int(steps[-1]) + 1)
            for begin in (self._first, max(self._first, self.top - TRIED)):
                slots = np.arange(begin, min(begin + TRIED, self.top + 1))
                fits = np.flatnonzero((self.check[slots[:, None] + steps] < 0).all(axis=1))
                if len(fits):
                    return int(slots[fits[0]])
        return self.top

    def add(self, parents: np.ndarray, codes: np.ndarray) -> None:
        """Children of nodes that have none yet, sorted by parent and code, each pair once."""
        begins = np.flatnonzero(np.diff(parents, prepend=-1))
        sizes = np.diff(np.append(begins, len(parents)))
        for begin, size in zip(begins[sizes > 1], sizes[sizes > 1], strict=True):
            own = codes[begin : begin + size]
            slot = self._place(own - own[0])
            self._reserve(slot + int(own[-1] - own[0]) + 1)
            self.base[parents[begin]] = slot - own[0]
            self.check[slot + own - own[0]] = parents[begin]
            self.top = max(self.top, slot + int(own[-1] - own[0]) + 1)
        single = begins[sizes == 1]
        if len(single):
            # an only child fits anywhere: holes first
            self._reserve(self.top + len(single))
            free = np.flatnonzero(self.check[self._first : self.top + len(single)] < 0)[: len(single)] + self._first
            self.base[parents[single]] = free - codes[single]
            self.check[free] = parents[single]
            self.top = max(self.top, int(free[-1]) + 1)
            self._first = int(free[-1]) + 1

    def child(self, nodes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The child of each node by its code, -1 where there is none."""
        slots = self.base[nodes] + codes
        inside = (slots >= 0) & (slots < len(self.check))
        found = inside & (self.check[np.where(inside, slots, 0)] == nodes)
        return np.where(found, slots, -1)


def _digest(path: bytes) -> bytes:
    return hashlib.md5(path, usedforsecurity=False).digest()


def _level_codes(nodes: np.ndarray, keys: list[bytes], codes: dict[bytes, int]) -> np.ndarray:
    """Dense codes of the next turns; new ones in the order of their parents, so that siblings lie together."""
    out = np.zeros(len(keys), np.int64)
    for i in np.argsort(nodes, kind="stable"):
        out[i] = codes.setdefault(keys[i], len(codes))
    return out


def shard_nodes(sequences: list[dict]) -> dict[str, list]:
    """The nodes of one shard. A sequence has ``keys`` (a digest per turn), ``chars`` (a length per turn), ``shared`` (the
    depth down to which other shards have its nodes, too), ``members``, ``low`` and ``sha``; no two have equal keys.

    Columns: ``shared`` tells nodes that others may have, whose sums hold this shard's part alone, without what
    shared nodes add by themselves. These come with their ``path``, the digests of all prefixes down to them.
    """
    trie, codes = DoubleArray(), {}
    count = len(sequences)
    lengths = np.array([len(s["keys"]) // KEY for s in sequences], np.int64)
    own = np.array([s["shared"] for s in sequences], np.int64)
    chars = [np.frombuffer(s["chars"], "<i8") for s in sequences]
    at = np.zeros(count, np.int64)
    levels, witness = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
    for depth in range(1, int(lengths.max()) + 1):
        going = np.flatnonzero(lengths >= depth)
        nodes = at[going]
        step = _level_codes(nodes, [sequences[i]["keys"][KEY * (depth - 1) : KEY * depth] for i in going], codes)
        order = np.lexsort((step, nodes))
        new = np.ones(len(going), bool)
        new[1:] = (np.diff(nodes[order]) != 0) | (np.diff(step[order]) != 0)
        chosen = order[new]
        trie.add(nodes[chosen], step[chosen])
        at[going] = trie.child(nodes, step)
        levels.append(at[going[chosen]])
        witness.append(going[chosen])
    size = trie.top
    members, low = np.zeros(size, np.int64), np.full(size, np.iinfo(np.int64).max)
    children, leaves, saved = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
    members[at] = [s["members"] for s in sequences]
    low[at] = [s["low"] for s in sequences]
    ends = {int(slot): s["sha"] for slot, s in zip(at, sequences, strict=True)}
    shared = np.zeros(size, bool)
    shared[0] = True
    for depth, (nodes, seen) in enumerate(zip(levels, witness, strict=True)):
        shared[nodes[own[seen] >= depth]] = True
    # up from the deepest level by CHECK, each node to its parent
    for depth in range(len(levels) - 1, 0, -1):
        nodes = levels[depth]
        alone = nodes[~shared[nodes]]
        leaves[alone] += children[alone] == 0
        last = np.array([chars[i][depth - 1] for i in witness[depth]], np.int64)
        saved[alone] += (members[alone] - 1) * last[~shared[nodes]]
        parents = trie.check[nodes]
        for values in (members, leaves, saved):
            np.add.at(values, parents, values[nodes])
        np.minimum.at(low, parents, low[nodes])
        np.add.at(children, trie.check[alone], 1)
    out: dict[str, list] = {c: [] for c in NODE_COLUMNS}
    for depth, (nodes, seen) in enumerate(zip(levels, witness, strict=True)):
        parents = trie.check[nodes]
        for slot, parent, i in zip(nodes.tolist(), parents.tolist(), seen.tolist(), strict=True):
            keys = sequences[i]["keys"]
            path = b"".join(_digest(keys[: KEY * d]) for d in range(depth + 1)) if shared[slot] else None
            above = depth > 0 and shared[parent]
            row = (
                bool(shared[slot]), path, _digest(keys[: KEY * (depth - 1)]) if above and path is None else None, depth, int(chars[i][depth - 1]) if depth else 0, int(low[slot]),
                None if above or not depth else int(low[parent]), int(members[slot]), int(children[slot]), int(leaves[slot]), int(saved[slot]), ends.get(slot),
            )
            for column, value in zip(out.values(), row, strict=True):
                column.append(value)
    return out


NODE_COLUMNS = {
    "shared": pa.bool_(), "path": pa.binary(), "above": pa.binary(), "depth": pa.int64(), "chars": pa.int64(), "conv_id": pa.int64(), "parent_conv_id": pa.int64(),
    "n_convs": pa.int64(), "n_children": pa.int64(), "n_leaves": pa.int64(), "saved_tokens": pa.int64(), "ends_sha256": pa.string(),
}
_NODES = (
    "shared boolean, path binary, above binary, depth bigint, chars bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, "
    "n_leaves bigint, saved_tokens bigint, ends_sha256 string"
)


def shared_turns(conv: int) -> int:
    """How many of its first turns a conversation takes from the first one of its block."""
    return zlib.crc32(str(conv).encode()) % (MOST_SHARED + 1)


def _rebuilt(turns: DataFrame) -> DataFrame:
    """One row per conversation, from turns sorted by block, its first conversation before the others, and place.

    Of a conversation its digests and lengths are held at a time, 24 bytes a turn; a task sends the turns of equal ones
    on once as long as it remembers them.
    """

    def conversations(batches) -> Iterator[tuple]:
        block, conv, base, keys, lengths = None, None, [], [], []

        def done() -> tuple:
            return conv, b"".join(keys), np.array(lengths, "<i8").tobytes()

        for batch in batches:
            for b, c, key, n in zip(*(batch.column(x).to_pylist() for x in ("block", "conv", "key", "chars")), strict=True):
                if b != block or c != conv:
                    if conv is not None:
                        yield done()
                    if b != block:
                        block, base = b, []
                    conv, place = c, 0
                    start = [] if c == b else base[: shared_turns(c)]
                    skipped = 0 if c == b else shared_turns(c)
                    keys, lengths = [k for k, _ in start], [n for _, n in start]
                if c == b and place < MOST_SHARED:
                    base.append((key, n))
                if place >= skipped:
                    keys.append(key)
                    lengths.append(n)
                place += 1
        if conv is not None:
            yield done()

    def rows(batches) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        held, size = [], 0

        def table() -> pa.RecordBatch:
            columns = list(zip(*held, strict=True))
            types = [pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["end", "conv", "turns", "keys", "chars"])

        for conv, keys, lengths in conversations(batches):
            end = _digest(keys)
            known = end in seen
            if not known:
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(end)
            held.append((end, conv, len(keys) // KEY, None if known else keys, None if known else lengths))
            size += 64 if known else 64 + 2 * len(keys)
            if size > tx.BLOCK_BYTES:
                yield table()
                held, size = [], 0
        if held:
            yield table()

    return turns.mapInArrow(rows, "end binary, conv bigint, turns bigint, keys binary, chars binary")


def _distinct(ordered: DataFrame) -> DataFrame:
    """One row per different sequence with its members, from rows sorted by ``end`` and ``conv``.

    The digest of a sequence's members is taken as they pass, so many of them need no memory.
    """

    def rows(batches) -> Iterator[pa.RecordBatch]:
        names = ["end", "turns", "members", "low", "sha", "keys", "chars"]
        types = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary()]
        out: list[list] = [[] for _ in names]
        end, members, low, turns, keys, chars, sha, size = None, 0, None, 0, None, None, None, 0

        def table() -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)

        for batch in batches:
            for e, conv, n, k, c in zip(*(batch.column(x).to_pylist() for x in ("end", "conv", "turns", "keys", "chars")), strict=True):
                if e != end:
                    if end is not None:
                        for column, value in zip(out, (end, turns, members, low, sha.hexdigest(), keys, chars), strict=True):
                            column.append(value)
                        size += 128 + 2 * len(keys)
                        if size > tx.BLOCK_BYTES:
                            yield table()
                            out, size = [[] for _ in names], 0
                    end, members, low, turns, keys, chars, sha = e, 0, conv, n, k, c, hashlib.sha256()
                sha.update(f",{conv}".encode() if members else str(conv).encode())
                members += 1
                if keys is None:
                    keys, chars = k, c
        if end is not None:
            for column, value in zip(out, (end, turns, members, low, sha.hexdigest(), keys, chars), strict=True):
                column.append(value)
            yield table()

    return ordered.mapInArrow(rows, "end binary, turns bigint, members bigint, low bigint, sha string, keys binary, chars binary")


def sequences(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The different rebuilt turn sequences: digests and lengths of their turns, members, smallest member."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    conv = F.col(conv_col).cast("bigint")
    block = conv - conv % BLOCK
    turns = conversations.filter(conv.isNotNull()).select(
        block.alias("block"), conv.alias("conv"), (conv != block).alias("rest"), F.col(turn_col).cast("bigint").alias("turn"), F.left(role, F.lit(32)).alias("r"),
        F.left(text, F.lit(32)).alias("t"), F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("key"), F.length(text).cast("bigint").alias("chars"),
    )
    turns = turns.repartition("block").sortWithinPartitions("block", "rest", "conv", "turn", "r", "t", "key")
    rebuilt = _rebuilt(turns.select("block", "conv", "key", "chars"))
    return _distinct(rebuilt.repartition("end").sortWithinPartitions("end", "conv"))


def _sharded(found: DataFrame) -> DataFrame:
    """``found`` with ``shared``, the depth down to which other shards may have the nodes of a sequence, and its ``shard``.

    A shard holds all sequences under one prefix: the first turn, or more turns where those under it have more than
    ``SHARD_TURNS`` turns together or than the share of one task.
    """
    spark = found.sparkSession
    total = found.agg(F.coalesce(F.sum("turns"), F.lit(0)).alias("n")).first()["n"]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD_TURNS))
    limit = max(min(SHARD_TURNS, 2 * total // parts), total // MOST_HEAVY)
    out = found.withColumn("shared", F.lit(0))
    depth = 1
    while True:
        prefix = F.substring("keys", 1, KEY * depth)
        under = out.filter((F.col("shared") == depth - 1) & (F.col("turns") >= depth))
        heavy = under.groupBy(prefix.alias("prefix")).agg(F.sum("turns").alias("n")).filter(F.col("n") > limit).select("prefix", F.lit(1).alias("heavy"))
        heavy = stored(heavy, "heavy-prefixes")
        if heavy.isEmpty():
            break
        # at most MOST_HEAVY of one depth can have more than the limit
        reached = (F.col("shared") == depth - 1) & (F.col("turns") >= depth)
        out = out.join(F.broadcast(heavy), prefix == F.col("prefix"), "left").withColumn("shared", F.when(reached & (F.col("heavy") == 1), depth).otherwise(F.col("shared")))
        out = out.drop("prefix", "heavy")
        depth += 1
    key = F.expr(f"substring(keys, 1, cast({KEY} * (shared + 1) as int))")
    return out.withColumn("shard", F.pmod(F.xxhash64(key), F.lit(parts))).repartition(parts, "shard").sortWithinPartitions("shard")


def _tries(sharded: DataFrame) -> DataFrame:
    """The nodes of all shards; a task holds one shard at a time."""
    columns = ["keys", "chars", "shared", "members", "low", "sha"]

    def tables(held: list[dict]) -> Iterator[pa.RecordBatch]:
        table = pa.table({c: pa.array(v, NODE_COLUMNS[c]) for c, v in shard_nodes(held).items()})
        yield from table.to_batches(max_chunksize=20_000)

    def rows(batches) -> Iterator[pa.RecordBatch]:
        shard, held = None, []
        for batch in batches:
            for number, row in zip(batch.column("shard").to_pylist(), batch.select(columns).to_pylist(), strict=True):
                if number != shard and held:
                    yield from tables(held)
                    held = []
                shard = number
                held.append(row)
        if held:
            yield from tables(held)

    return sharded.select("shard", *columns).mapInArrow(rows, _NODES)


def _merged(parts: DataFrame) -> DataFrame:
    """The shared nodes, each with the sums of all shards and with what shared nodes below it add."""
    sums = parts.groupBy(F.expr(f"substring(path, {-KEY}, {KEY})").alias("id")).agg(
        F.first("path").alias("path"), F.max("depth").alias("depth"), F.max("chars").alias("chars"), F.min("conv_id").alias("conv_id"), F.max("ends_sha256").alias("ends_sha256"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
    )
    sums = sums.withColumn("above", F.when(F.col("depth") > 0, F.expr(f"substring(path, cast({KEY} * (depth - 1) + 1 as int), {KEY})")))
    below = sums.groupBy(F.col("above").alias("id")).agg(F.count(F.lit(1)).alias("more")).filter("id is not null")
    sums = sums.join(below, "id", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0))).drop("more")
    along = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("depth")), lambda d: F.substr("path", (d * KEY + 1).cast("int"), F.lit(KEY)))
    added = sums.select(
        F.explode(along).alias("id"), (F.col("n_children") == 0).cast("bigint").alias("leaf"), ((F.col("n_convs") - 1) * F.col("chars")).alias("own")
    )
    added = added.groupBy("id").agg(F.sum("leaf").alias("leaf"), F.sum("own").alias("own"))
    sums = sums.join(added, "id").withColumns({"n_leaves": F.col("n_leaves") + F.col("leaf"), "saved_tokens": F.col("saved_tokens") + F.col("own")})
    parents = sums.select(F.col("id").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    return sums.drop("leaf", "own").join(parents, "above", "left")


def nodes(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per node of the tree of rebuilt conversations.

    Turns are ordered by ``turn``, null first, equal ones by role and text (their first 32 characters, then a digest). A null
    role or text is empty. Conversation c takes its first h turns from conversation c - c % 100 (fewer if that has fewer,
    none if it is absent) and the rest from its own after the first h, where h is the CRC-32 of c in decimal, modulo 6. Turns
    are told apart by a digest of 128 bits. Repeated rows are repeated turns; rows without a conversation id are in no conversation; an
    empty table gives no rows; other columns are ignored.

    Columns ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves`` (nodes without
    children in the subtree), ``saved_tokens`` (over the subtree, characters of the last text times members less one) and
    ``ends_sha256`` (of the members that end here, ascending, comma-joined).
    """
    tx.small_batches(conversations.sparkSession, 4096)
    found = stored(sequences(conversations, conv_col, turn_col, role_col, text_col), "sequences")
    all_nodes = stored(_tries(_sharded(found)), "nodes")
    parts = all_nodes.filter("shared")
    shared = stored(_merged(parts), "shared-nodes")
    rows = shared.count()
    discard(found)
    names = shared.select(F.col("id").alias("above"), F.col("conv_id").alias("above_conv"))
    alone = all_nodes.filter("not shared").join(F.broadcast(names) if rows <= MOST_BROADCAST else names, "above", "left")
    alone = alone.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above_conv"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256")]
    return alone.select(*columns).unionByName(shared.select(*columns))
