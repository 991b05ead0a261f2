"""Near duplicates by exact Jaccard similarity of word shingles, filtered under several global token orders."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tandem.llm import text as tx
from tandem.llm.graph import components, extend, gathered
from tandem.session import discard, stored

SKETCH_BITS = 22
_SLICE = 1 << 16
HUBS = 4
# Pairs of one task that reads two prefixes, or two whole sets, for each of them.
PREFIX_PAIRS = 50_000
SET_PAIRS = 2_000

_HEADS = "doc bigint, n bigint, f1 bigint, f2 bigint, p0 array<bigint>, p1 array<int>, p2 array<int>"


def _sketch(docs: DataFrame, size: int) -> np.ndarray:
    """Document frequencies of shingles by hash bucket, over all documents: a table of fixed size."""

    def partial(batches) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        held, waiting = [], 0
        for batch in batches:
            for tokens in tx.shingle_sets(*tx.buffers(batch.column("text")), size):
                held.append((tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64))
                waiting += len(tokens)
                if waiting > 1 << 21:
                    counts += np.bincount(np.concatenate(held), minlength=len(counts)).astype(np.uint32)
                    held, waiting = [], 0
        if held:
            counts += np.bincount(np.concatenate(held), minlength=len(counts)).astype(np.uint32)
        for part in range(len(counts) // _SLICE):
            piece = counts[part * _SLICE : (part + 1) * _SLICE]
            if piece.any():
                yield pa.record_batch([pa.array([part], pa.int32()), pa.array([zlib.compress(piece.tobytes(), 1)])], ["part", "counts"])

    def total(batches) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, packed in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                piece = np.frombuffer(zlib.decompress(packed), np.uint32)
                sums[part] = sums.get(part, 0) + piece.astype(np.uint64)
        for part, piece in sums.items():
            yield pa.record_batch([pa.array([part], pa.int32()), pa.array([zlib.compress(piece.tobytes(), 1)])], ["part", "counts"])

    schema = "part int, counts binary"
    slices = docs.select("text").mapInArrow(partial, schema).repartition("part").mapInArrow(total, schema)
    out = np.zeros(1 << SKETCH_BITS, np.uint16)
    for row in slices.collect():  # one row per slice of the fixed table
        counts = np.frombuffer(zlib.decompress(row["counts"]), np.uint64)
        out[row["part"] * _SLICE : (row["part"] + 1) * _SLICE] = np.minimum(counts, (1 << 16) - 1)
    return out


def _prefix(keys: np.ndarray, tokens: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` first tokens by key and then token, in that order."""
    if count < len(keys):
        least = keys <= np.partition(keys, count - 1)[count - 1]
        keys, tokens = keys[least], tokens[least]
    return tokens[np.lexsort((tokens, keys))][:count]


def _filter_prefix(keys: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` smallest keys, by their low 32 bits: enough for a filter, which may let more through but loses nothing."""
    least = np.partition(keys, count - 1)[:count] if count < len(keys) else keys
    return (least & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _heads(docs: DataFrame, size: int, percent: int, counts) -> DataFrame:
    """Per document its set size, a fingerprint of its set and its prefix under each of three token orders.

    The first order is by document frequency, rarest first, the other two are random permutations.
    """

    def rows(batches) -> Iterator[pa.RecordBatch]:
        table = counts.value
        for batch in batches:
            sizes, prints, prefixes = [], [], ([], [], [])
            for tokens in tx.shingle_sets(*tx.buffers(batch.column("text")), size):
                n = len(tokens)
                sizes.append(n)
                scrambled = tx.mix(tokens, 3)
                prints.append((int(scrambled.sum(dtype=np.uint64)), int(tx.mix(tokens, 4).sum(dtype=np.uint64))))
                need = n - -(-percent * n // 100) + 1
                rare = (table[tokens >> np.uint64(64 - SKETCH_BITS)].astype(np.uint64) << np.uint64(40)) | (scrambled >> np.uint64(24))
                prefixes[0].append(_prefix(rare, tokens, need) if n else tokens)
                for out, salt in zip(prefixes[1:], (5, 6), strict=True):
                    out.append(_filter_prefix(tx.mix(tokens, salt), need) if n else tokens.astype(np.uint32))
            f = np.array(prints, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.record_batch(
                [batch.column("doc"), pa.array(sizes, pa.int64()), pa.array(f[:, 0].copy()), pa.array(f[:, 1].copy()), *map(tx.lists, prefixes)],
                ["doc", "n", "f1", "f2", "p0", "p1", "p2"],
            )

    return docs.mapInArrow(rows, _HEADS)


def _sets(docs: DataFrame, size: int) -> DataFrame:
    def rows(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(tx.shingle_sets(*tx.buffers(batch.column("text")), size))
            yield pa.record_batch([batch.column("doc"), tx.lists(sets)], ["doc", "tokens"])

    return docs.mapInArrow(rows, "doc bigint, tokens array<bigint>")


def _side(table: DataFrame, name: str, *columns: str) -> DataFrame:
    return table.select(F.col("doc").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in columns])


def _asked(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("x", "y")).alias("doc")).distinct()


def _filtered(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Candidate pairs that share a prefix token under the other orders too.

    Pairs and the prefixes they ask for are written first, so that joins are planned by their true sizes and the
    prefixes of all other classes stay where they are.
    """
    pairs = gathered(stored(pairs, "candidates"), PREFIX_PAIRS)
    prefixes = gathered(stored(classes.join(_asked(pairs), "doc", "left_semi").select("doc", "p1", "p2"), "prefixes"), 2 * PREFIX_PAIRS)
    wide = pairs.join(_side(prefixes, "x", "p1", "p2"), "x").join(_side(prefixes, "y", "p1", "p2"), "y")
    kept = wide.filter(F.arrays_overlap("x_p1", "y_p1") & F.arrays_overlap("x_p2", "y_p2")).select("x", "y").distinct()
    kept = gathered(stored(kept, "pairs"), SET_PAIRS)
    discard(pairs, prefixes)
    return kept


def _linked(pairs: DataFrame, docs: DataFrame, repeated: DataFrame | None, size: int, percent: int) -> DataFrame:
    """The pairs whose whole sets are similar enough; sets are built again for the texts that are asked for.

    Only ``repeated`` ids can give a set twice, so only theirs are moved to be told apart.
    """
    asked = docs.join(_asked(pairs), "doc", "left_semi")
    if repeated is None:
        sets = _sets(asked, size)
    else:
        several = _sets(asked.join(repeated, "doc", "left_semi"), size).dropDuplicates(["doc", "tokens"])
        sets = _sets(asked.join(repeated, "doc", "left_anti"), size).unionByName(several)
    sets = gathered(stored(sets, "shingle-sets"), 2 * SET_PAIRS)
    wide = pairs.join(_side(sets, "x", "tokens"), "x").join(_side(sets, "y", "tokens"), "y")
    shared = F.size(F.array_intersect("x_tokens", "y_tokens"))
    union = F.size("x_tokens") + F.size("y_tokens") - shared
    found = wide.filter(shared * 100 >= union * percent).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
    found = stored(found, "found")
    discard(sets)
    return found


def _may_link(percent: int):
    """Whether lengths and positions allow a link, if the token is the first that both prefixes share.

    A link needs an overlap of ``percent`` / (100 + ``percent``) of both sizes, and no more than the rest of either set
    from its position on can be shared.
    """
    rest = F.least(F.col("x_n") - F.col("x_at"), F.col("y_n") - F.col("y_at"))
    return (F.least("x_n", "y_n") * 100 >= F.greatest("x_n", "y_n") * percent) & (rest * (100 + percent) >= (F.col("x_n") + F.col("y_n")) * percent)


def _either_way(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def linked_classes(docs: DataFrame, classes: DataFrame, repeated: DataFrame | None, size: int, percent: int) -> DataFrame:
    """``(node, component)`` of all classes with a link, as all links would give them.

    Classes meet in the posting list of a shared prefix token. First each list is compared with one class only,
    the one that shares most tokens with others. Then only lists whose members are not yet in one component go on, block by block of ``HUBS`` further
    members against the rest (blocks grow fourfold), skipping pairs that are already connected, until every list is
    done. So a large group of near copies costs about one comparison per member, and nothing is left out.
    """
    postings = classes.select(F.posexplode("p0").alias("at", "token"), "doc", "n")
    lists = postings.groupBy("token").agg(F.count(F.lit(1)).alias("members"))
    shared = gathered(stored(postings.join(lists.filter("members > 1"), "token"), "postings"))
    # the class that others are copies of has the tokens of all of them, so it is in the longest lists
    central = shared.groupBy("doc").agg(F.sum("members").alias("reach"))
    ordered = gathered(stored(shared.drop("members").join(central, "doc"), "postings"))
    discard(shared)
    shared = ordered
    hub = shared.groupBy("token").agg(F.max(F.struct(F.col("reach"), -F.col("doc"), "doc", "n", "at")).alias("hub"))
    pairs = shared.join(hub, "token").filter(F.col("doc") != F.col("hub.doc"))
    pairs = pairs.select(F.col("hub.doc").alias("x"), F.col("doc").alias("y"), F.col("hub.n").alias("x_n"), F.col("n").alias("y_n"), F.col("hub.at").alias("x_at"), F.col("at").alias("y_at"))
    tested = _filtered(_either_way(pairs.filter(_may_link(percent))), classes)
    groups = gathered(stored(components(_linked(tested, docs, repeated, size, percent)), "groups"))
    first, block, left, ranked = 1, HUBS, shared, None
    while True:
        # who was a hub is done with, so only members from the next rank on decide whether a list goes on
        member = left.join(groups.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
        open_lists = member.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("token")
        member = member.join(open_lists, "token", "left_semi")
        if ranked is None:
            rank = F.row_number().over(Window.partitionBy("token").orderBy(F.desc("reach"), "doc", F.desc("n"), F.desc("at"))) - 1
            member = member.withColumn("rank", rank).filter(F.col("rank") >= first)
        ranked = gathered(stored(member, "open-lists"))
        discard(left)
        hubs = ranked.filter(F.col("rank") < first + block)
        hubs = hubs.select("token", F.col("doc").alias("x"), F.col("n").alias("x_n"), F.col("at").alias("x_at"), F.col("component").alias("x_c"), F.col("rank").alias("x_rank"))
        pairs = ranked.withColumnsRenamed({"doc": "y", "n": "y_n", "at": "y_at"}).join(hubs, "token")
        pairs = pairs.filter((F.col("rank") > F.col("x_rank")) & (F.col("component") != F.col("x_c")) & _may_link(percent))
        pairs = _filtered(_either_way(pairs).join(tested, ["x", "y"], "left_anti"), classes)
        first, block = first + block, block * 4
        if not pairs.isEmpty():
            tested = tested.unionByName(pairs)
            more = _linked(pairs, docs, repeated, size, percent)
            if not more.isEmpty():
                wider = gathered(stored(extend(groups, more), "groups"))
                discard(groups)
                groups = wider
        rest = ranked.filter(F.col("rank") >= first)
        if rest.isEmpty():
            discard(ranked)
            return groups
        left = rest.drop("component")
        left.stored_at = ranked.stored_at


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_shingles`` and ``component_id``, the smallest id reachable by links.

    Two documents link when the Jaccard similarity of their sets of ``size``-word shingles is at least
    ``percent`` / 100. Words are runs without white space, A-Z lower-cased. Documents with equal sets are one class
    first. Candidates must share a prefix token under three global token orders; candidates are verified on
    whole sets of 64-bit shingle hashes. A null or empty text, or one of white space, has an empty set and is its
    own component; a shorter text is one shingle. A row without an id gets no component and links with nothing. An
    id with several texts is one document with several sets: a link of any of them counts. An empty
    table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    tx.small_batches(spark)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).cast("string").alias("text"))
    counts = spark.sparkContext.broadcast(_sketch(rows, size))  # 8 MB, whatever the input
    wide = stored(_heads(rows, size, percent, counts), "heads")
    counts.destroy()
    heads = stored(wide.select("doc", "n", "f1", "f2"), "sizes")
    known = wide.filter("n > 0 and doc is not null")
    classes = known.groupBy("n", "f1", "f2").agg(F.min("doc").alias("doc"), *[F.min_by(p, "doc").alias(p) for p in ("p0", "p1", "p2")])
    classes = stored(classes, "classes")
    discard(wide)
    repeated = stored(heads.filter("doc is not null").groupBy("doc").count().filter("count > 1").select("doc"), "repeated-ids")
    repeated = None if repeated.isEmpty() else repeated
    groups = linked_classes(rows.filter("doc is not null"), classes, repeated, size, percent).withColumnRenamed("node", "doc")
    named = classes.select("n", "f1", "f2", "doc").join(groups, "doc", "left")
    named = named.select("n", "f1", "f2", F.coalesce("component", "doc").alias("component"))
    out = heads.select("doc", "n", "f1", "f2").join(named, ["n", "f1", "f2"], "left")
    component = F.when(F.col("doc").isNotNull(), F.coalesce("component", "doc"))
    return out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"))


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the near duplicates of a kept row: of each component the row with the smallest id stays.

    All rows without words or without an id stay, repeated ones too. Of other rows that share the kept id, those with one
    text stay once.
    """
    groups = near_duplicates(docs, id_col, text_col, size, percent)
    gone = groups.filter("component_id is not null and doc_id <> component_id").select(F.col("doc_id").alias("__gone"))
    kept = docs.join(gone.distinct(), docs[id_col] == F.col("__gone"), "left_anti")
    comparable = F.col(id_col).isNotNull() & F.coalesce(F.col(text_col).cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return kept.filter(comparable).dropDuplicates([id_col, text_col]).unionByName(kept.filter(~comparable))
