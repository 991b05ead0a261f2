"""Approximate nearest neighbours by permutations of pivots: inverted files, footrule distance, exact rerank."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tandem.session import stored

PIVOTS = 256
PREFIX = 64
SEGMENT_ROWS = 16_384
QUERY_BLOCK = 8_192
# Share of a segment's vectors that is reranked for a query, at every size.
RERANKED = 0.15

_HITS = "query_id bigint, vec_id bigint, score double"


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(vec_id, vector)`` of rows with an id and a vector of finite numbers, not all zero, of the most usual length."""
    vector = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), vector.alias("vector")).filter("vec_id is not null and vector is not null")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(finite & F.exists("vector", lambda x: x != 0))
    sizes = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    return rows.filter(F.size("vector") == (sizes[0]["size"] if sizes else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    width = len(column[0]) if len(column) else 0
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _unit(x: np.ndarray) -> np.ndarray:
    # scaled first, so that squares of very large or small numbers stay in range
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows brought to a largest component near one by a power of two: no digit changes, and squares stay in range."""
    _, exponent = np.frexp(np.abs(x).max(1, keepdims=True))
    return np.ldexp(x, -exponent)


def build(vectors: DataFrame, pivots: int = PIVOTS, prefix: int = PREFIX) -> DataFrame:
    """Every vector with the numbers of its ``prefix`` nearest pivots in order, written to the shared folder.

    Pivots are a fixed number of vectors, those with the smallest hash of their ids. Rows are dealt to segments of
    about ``SEGMENT_ROWS`` by their ids, so that results do not depend on how the table is partitioned.
    """
    spark = vectors.sparkSession
    segments = max(1, -(-vectors.count() // SEGMENT_ROWS))
    chosen = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()
    shared = spark.sparkContext.broadcast(_unit(np.array([r["vector"] for r in chosen])) if chosen else np.zeros((0, 0)))

    def rows(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = _unit(_matrix(batch.column("vector"))) @ shared.value.T
                order = np.argsort(-near, axis=1, kind="stable")[:, :prefix].astype(np.int16)
                offsets = pa.array(np.arange(0, order.size + 1, order.shape[1], dtype=np.int32))
                yield pa.record_batch([batch.column("vec_id"), batch.column("vector"), pa.ListArray.from_arrays(offsets, pa.array(order.ravel()))], ["vec_id", "vector", "near"])

    index = vectors.mapInArrow(rows, "vec_id bigint, vector array<double>, near array<smallint>")
    return stored(index.withColumn("segment", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(segments)).cast("int")), "permutation-index")


class _Segment:
    """Some of the index in a task: for each pivot the vectors that list it and at which rank."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, near: np.ndarray, pivots: int) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.x, near = ids[order], _scaled(x[order]), near[order]
        self.length = np.sqrt((self.x * self.x).sum(1))
        flat = near.ravel()
        place = np.argsort(flat, kind="stable")
        self.rows, self.ranks = place // near.shape[1], place % near.shape[1]
        self.starts = np.searchsorted(flat[place], np.arange(pivots + 1))

    def candidates(self, near: np.ndarray, top: int) -> np.ndarray:
        """The share of rows (the query and ``top`` others at least) with the smallest footrule distance to a query, ties to smaller ids.

        With a pivot that one side does not list counted at the rank after its last, each shared pivot brings the
        distance down by twice the smaller remaining depth: rows are scored by that.
        """
        prefix, n = len(near), len(self.ids)
        wanted = max(top + 1, int(np.ceil(RERANKED * n)))
        if wanted >= n:
            return np.arange(n)
        gain = np.zeros(n, np.int64)
        for rank, pivot in enumerate(near):
            lo, hi = self.starts[pivot], self.starts[pivot + 1]
            gain[self.rows[lo:hi]] += 2 * (prefix - np.maximum(rank, self.ranks[lo:hi]))
        key = gain * n + np.arange(n - 1, -1, -1)
        return np.argpartition(-key, wanted - 1)[:wanted]

    def nearest(self, query_id: int, q: np.ndarray, near: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
        rows = self.candidates(near, top)
        rows = rows[self.ids[rows] != query_id]
        if not len(rows):
            return rows, np.zeros(0)
        q = _scaled(q[None])[0]
        about = (self.x[rows] @ q) / self.length[rows]
        if len(rows) > top:
            # sums of one row are added in one order, whatever is beside it, so copies get equal scores
            limit = np.partition(about, len(about) - top)[len(about) - top]
            rows = rows[about >= limit - 1e-9 * np.sqrt((q * q).sum())]
        score = (self.x[rows] * q).sum(1) / (self.length[rows] * np.sqrt((q * q).sum()))
        best = np.lexsort((self.ids[rows], -score))[:top]
        return self.ids[rows[best]], score[best]


def search(index: DataFrame, queries: DataFrame, top: int = 5, pivots: int = PIVOTS) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``top`` nearest found for each query, by cosine, ties to smaller ids.

    Queries are sent to all segments of the index in blocks of ``QUERY_BLOCK``; a segment gives its best few for
    each, and these are merged.
    """
    spark = index.sparkSession

    def block(held: list) -> DataFrame:
        ids = np.array([r["vec_id"] for r in held], np.int64)
        shared = spark.sparkContext.broadcast((ids, np.array([r["vector"] for r in held]), np.array([r["near"] for r in held])))

        def answer(rows: pa.Table) -> pa.Table:
            batch = rows.combine_chunks()
            columns = [batch.column(c).chunk(0) for c in ("vec_id", "vector", "near")]
            segment = _Segment(columns[0].to_numpy(), _matrix(columns[1]), _matrix(columns[2]), pivots)
            found = [(q, *segment.nearest(q, v, near, top)) for q, v, near in zip(*shared.value, strict=True)]
            query = np.repeat([q for q, _, _ in found], [len(i) for _, i, _ in found])
            columns = [query.astype(np.int64), np.concatenate([i for _, i, _ in found]), np.concatenate([s for _, _, s in found])]
            return pa.table([pa.array(c) for c in columns], ["query_id", "vec_id", "score"])

        return index.groupBy("segment").applyInArrow(answer, _HITS)

    held, parts = [], []
    for row in stored(queries.dropDuplicates(["vec_id"]), "queries").toLocalIterator():
        held.append(row)
        if len(held) == QUERY_BLOCK:
            parts.append(block(held))
            held = []
    if held or not parts:
        parts.append(block(held) if held else spark.createDataFrame([], _HITS))
    hits = reduce(DataFrame.unionByName, parts).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, is_query, top: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The nearest rows of every row for which ``is_query`` (a condition on ``vec_id``) holds.

    Rows without an id, and vectors that are null, zero, of another length than most, or hold a null or non-finite
    number take no part. An id with several vectors is a candidate with each and keeps the best; as a query it is
    searched with one of them. Fewer than ``top`` candidates give fewer rows, an empty table none; other columns are
    ignored.
    """
    rows = usable(vectors, id_col, vector_col)
    index = build(rows)
    return search(index, index.filter(is_query).groupBy("vec_id").agg(F.min("vector").alias("vector"), F.min_by("near", "vector").alias("near")), top)
