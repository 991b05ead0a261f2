"""Quality of texts by how much better a dictionary of good text compresses them than one of bad text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm import labelled
from tandem.llm.text import small_batches

SAMPLE_PER_CLASS = 2000
SAMPLE_MAX_CHARS = 30_000
DICTIONARY_BYTES = 112_640
CHUNK_BYTES = 2048
LEVEL = 3


@dataclass
class Model:
    """Two dictionaries and the weights that turn size differences into a probability; no weights give ``share``."""

    good: bytes
    bad: bytes
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None
    share: float


def _chunks(data: bytes) -> list[bytes]:
    """A text in pieces of equal size, so that what it repeats far back does not hide what the dictionary adds."""
    count = max(1, -(-len(data) // CHUNK_BYTES))
    size = -(-len(data) // count) if data else 1
    return [data[at : at + size] for at in range(0, len(data), size)]


def _dictionary(texts: list[bytes]) -> bytes:
    chunks = [c for t in texts for c in _chunks(t)]
    try:
        return zstd.train_dictionary(DICTIONARY_BYTES, chunks).as_bytes()
    except zstd.ZstdError:
        # too little text to train on: the text itself, as raw content
        return b"".join(chunks)[-DICTIONARY_BYTES:]


class _Sizes:
    """Compressed sizes without a dictionary and with either one."""

    def __init__(self, good: bytes, bad: bytes) -> None:
        options = {"level": LEVEL, "write_content_size": False, "write_dict_id": False}
        self._all = [zstd.ZstdCompressor(**options)]
        for held in (good, bad):
            kind = zstd.ZstdCompressionDict(held) if len(held) >= 8 else None
            self._all.append(zstd.ZstdCompressor(dict_data=kind, **options) if kind else self._all[0])

    def features(self, text: str) -> tuple[float, ...]:
        """The normalised difference over all chunks and at its worst chunk, the plain compression ratio, the length."""
        data = text.encode()
        if not data:
            return 0.0, 0.0, 1.0, 0.0
        sizes = np.array([[len(c.compress(chunk)) for c in self._all] for chunk in _chunks(data)], float)
        plain, good, bad = sizes.sum(0)
        worst = ((sizes[:, 2] - sizes[:, 1]) / sizes[:, 0]).min()
        return (bad - good) / plain, worst, plain / len(data), float(np.log1p(len(data)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality") -> Model:
    """Dictionaries from one half of the labelled sample, calibration by logistic regression on the other half.

    The sample has up to ``SAMPLE_PER_CLASS`` texts per class of at most ``SAMPLE_MAX_CHARS`` characters each. Without
    labels of both classes the model knows only the share of good documents.
    """
    rows, share = labelled.sample(docs, labels, id_col, text_col, label, SAMPLE_PER_CLASS, SAMPLE_MAX_CHARS)
    good, bad = ([t.encode() for t, y in rows if y == k][::2] for k in (1, 0))
    rest = [r for k in (0, 1) for r in [r for r in rows if r[1] == k][1::2]]
    y = np.array([k for _, k in rest], float)
    if not good or not bad or len(set(y.tolist())) < 2:
        return Model(b"", b"", np.zeros(4), np.ones(4), None, share)
    held = _dictionary(good), _dictionary(bad)
    sizes = _Sizes(*held)
    x = np.array([sizes.features(t) for t, _ in rest])
    centre, scale = x.mean(0), x.std(0) + 1e-9
    weights = labelled.logistic((x - centre) / scale, y, labelled.class_weights(y, share))
    return Model(*held, centre, scale, weights, share)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score)`` for every row, whole texts; a null text is empty, and a row without an id keeps a null id."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of fixed size

    def rows(batches) -> Iterator[pa.RecordBatch]:
        m = shared.value
        sizes = _Sizes(m.good, m.bad)
        for batch in batches:
            if m.weights is None:
                out = np.full(batch.num_rows, m.share)
            else:
                x = np.array([sizes.features(t.as_py() if t.is_valid else "") for t in batch.column("text")]).reshape(-1, 4)
                z = (x - m.centre) / m.scale @ m.weights[:-1] + m.weights[-1]
                out = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.record_batch([batch.column("doc"), pa.array(out)], ["doc_id", "score"])

    plain = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(rows, "doc_id bigint, score double")


def report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` (score of 0.5 or more) for every row of ``docs``."""
    scored = score(docs, fit(docs, labels, id_col, text_col), id_col, text_col)
    return scored.select("doc_id", labelled.is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose text scores below the threshold; other columns as they are."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col))
    at = docs.columns.index(text_col)

    def rows(batches) -> Iterator[pa.RecordBatch]:
        m = shared.value
        sizes = _Sizes(m.good, m.bad)
        for batch in batches:
            texts = batch.column(at)
            if m.weights is None:
                keep = np.full(batch.num_rows, m.share >= threshold)
            else:
                x = np.array([sizes.features(str(t.as_py()) if t.is_valid else "") for t in texts]).reshape(-1, 4)
                z = (x - m.centre) / m.scale @ m.weights[:-1] + m.weights[-1]
                keep = 1 / (1 + np.exp(-np.clip(z, -30, 30))) >= threshold
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(rows, docs.schema)
