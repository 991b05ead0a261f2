"""Toxicity of texts: vectors of character n-grams averaged into a linear softmax, trained jointly in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm import labelled
from tandem.llm import text as tx

SAMPLE_PER_CLASS = 2500
SAMPLE_MAX_CHARS = 20_000
BUCKETS = 1 << 17
DIMENSIONS = 8
GRAMS = (3, 4, 5, 6)
WINDOW_WORDS = 2
EPOCHS = 80
RATE, MOMENTUM = 0.05, 0.9

_CLASS = np.where(np.isin(np.arange(256), tx.PUNCTUATION), 32, np.arange(256)).astype(np.uint8)
_CODES = np.random.Generator(np.random.PCG64(31)).integers(1, 1 << 63, 256, dtype=np.uint64)


def _grams(data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts and their character n-grams: first byte and text of each word, bucket and word of each n-gram.

    A word is padded by one space on either side; an n-gram lies in the padded word.
    """
    # every text gets a space before and after, so that words never touch
    sizes = np.diff(places)
    padded = np.full(len(data) + 2 * len(sizes) + 2, 32, np.uint8)
    shift = np.repeat(2 * np.arange(len(sizes)) + 1, sizes)
    padded[np.arange(len(data)) + shift] = _CLASS[data]
    space = padded == 32
    starts = np.flatnonzero(~space[1:] & space[:-1]) + 1
    if not len(starts):
        nothing = np.zeros(0, np.int64)
        return nothing, nothing, nothing, nothing
    owner = np.searchsorted(places[1:-1] + 2 * np.arange(1, len(sizes)), starts, "right")
    ends = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    word_at = np.cumsum(np.bincount(starts - 1, minlength=len(padded))) - 1
    # the padded word of a place reaches to the space after it
    last = ends[np.maximum(word_at, 0)]
    place = np.arange(len(padded))
    codes = _CODES[padded]
    run, buckets, words = codes, [], []
    for size in range(2, max(GRAMS) + 1):
        run = run[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[size - 1 :]
        if size in GRAMS:
            at = place[: len(run)]
            inside = np.flatnonzero((word_at[: len(run)] >= 0) & (at + size - 1 <= last[: len(run)]))
            buckets.append((tx.mix(run[inside], size) >> np.uint64(64 - 17)).astype(np.int64))
            words.append(word_at[inside])
    return starts, owner, np.concatenate(buckets), np.concatenate(words)


def _word_scores(table: np.ndarray, buckets: np.ndarray, words: np.ndarray, count: int) -> np.ndarray:
    """The mean of the n-gram scores of each word; a word of one letter may have none and scores 0."""
    total = np.bincount(words, weights=table[buckets], minlength=count)
    return total / np.maximum(1, np.bincount(words, minlength=count))


def _windows(scores: np.ndarray, owner: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and past-last word of every window and its text; a shorter text is one window."""
    cuts = np.searchsorted(owner, np.arange(count + 1))
    first = np.arange(len(scores))
    last = np.minimum(first + WINDOW_WORDS, cuts[owner + 1])
    whole = (last - first == WINDOW_WORDS) | (first == cuts[owner])
    return first[whole], last[whole], owner[whole]


def _pooled(scores: np.ndarray, owner: np.ndarray, count: int) -> np.ndarray:
    """The highest window mean of each text; 0 for a text without words."""
    out = np.zeros(count)
    if len(scores):
        first, last, text = _windows(scores, owner, count)
        sums = np.concatenate([[0.0], np.cumsum(scores)])
        means = (sums[last] - sums[first]) / (last - first)
        begins = np.flatnonzero(np.diff(text, prepend=-1))
        out[text[begins]] = np.maximum.reduceat(means, begins)
    return out


@dataclass
class Model:
    """The score of each n-gram bucket (its vector times the softmax weights) and the calibration; None if untrained."""

    table: np.ndarray | None
    slope: float
    constant: float
    share: float


def _train(texts: list[bytes], y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Joint training of n-gram vectors and softmax weights by Adam; gives the scores of the buckets.

    A text is as toxic as its most toxic window: its logit is a soft maximum over windows that sharpens while training.
    Different words are looked at once per round, each for all of its places.
    """
    places = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=places[1:])
    data = np.frombuffer(b"".join(texts), np.uint8)
    hashes, owner, starts = tx.hash_words(data, places, tx.PUNCTUATION)
    _, first, word = np.unique(hashes, return_index=True, return_inverse=True)
    after = np.append(starts, len(data))
    different = [bytes(_CLASS[data[starts[i] : after[i + 1]]]).strip() for i in first]
    # a word that ends a text may be followed by the next one without a space
    different = [d.split(b" ")[0] for d in different]
    lengths = np.zeros(len(different) + 1, np.int64)
    np.cumsum([len(d) for d in different], out=lengths[1:])
    _, owner_of, buckets, gram_word = _grams(np.frombuffer(b"".join(different), np.uint8), lengths)
    gram_word = owner_of[gram_word]
    per_word = np.maximum(1, np.bincount(gram_word, minlength=len(different)))
    begin, end, text = _windows(np.zeros(len(word)), owner, len(texts))
    size = (end - begin).astype(float)
    rng = np.random.Generator(np.random.PCG64(5))
    vectors = rng.normal(0, 0.01, (BUCKETS, DIMENSIONS))
    softmax = rng.normal(0, 0.5, (2, DIMENSIONS))
    bias = 0.0
    speed = np.zeros_like(vectors), np.zeros_like(softmax)
    edges = np.flatnonzero(np.diff(text, prepend=-1))
    shown = text[edges]
    used = np.unique(buckets)
    for epoch in range(1, EPOCHS + 1):
        sharp = 1 + 7 * epoch / EPOCHS
        direction = softmax[1] - softmax[0]
        table = vectors @ direction
        word_score = np.bincount(gram_word, weights=table[buckets], minlength=len(different)) / per_word
        sums = np.concatenate([[0.0], np.cumsum(word_score[word])])
        z = (sums[end] - sums[begin]) / size
        top = np.maximum.reduceat(z, edges)
        at = np.searchsorted(shown, text)
        share = np.exp(sharp * (z - top[at]))
        total = np.add.reduceat(share, edges)
        share /= total[at]
        logit = top + np.log(total / np.diff(np.append(edges, len(z)))) / sharp + bias
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        error = (p - y[shown]) * weight[shown] / weight[shown].sum()
        pull = error[at] * share / size
        spread = np.bincount(begin, weights=pull, minlength=len(word) + 1) - np.bincount(end, weights=pull, minlength=len(word) + 1)
        by_word = np.bincount(word, weights=np.cumsum(spread)[: len(word)], minlength=len(different)) / per_word
        by_bucket = np.bincount(buckets, weights=by_word[gram_word], minlength=BUCKETS)
        g_vectors = by_bucket[used, None] * direction + 1e-7 * vectors[used]
        g_direction = vectors.T @ by_bucket
        g_softmax = np.stack([-g_direction, g_direction]) + 1e-5 * softmax
        g_bias = error.sum()
        # steps of one length for a whole array: a rare n-gram moves as little as its gradient says, so it is not learnt by heart
        for values, gradient, kept, rows in ((vectors, g_vectors, speed[0], used), (softmax, g_softmax, speed[1], slice(None))):
            kept[rows] = MOMENTUM * kept[rows] + gradient / (np.abs(gradient).max() + 1e-12)
            values[rows] -= RATE * np.sqrt(1 - epoch / (EPOCHS + 1)) * kept[rows]
        bias -= RATE * np.sign(g_bias) * min(1.0, abs(g_bias) * 10)
    table = vectors @ (softmax[1] - softmax[0])
    seen = np.zeros(BUCKETS, bool)
    seen[used] = True
    # a bucket that training never saw says nothing
    return np.where(seen, table, 0.0)


def _logits(texts: list[bytes], table: np.ndarray) -> np.ndarray:
    out, places = np.zeros(len(texts)), np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=places[1:])
    data = np.frombuffer(b"".join(texts), np.uint8)
    for first, last in tx.groups(places, tx.BLOCK_BYTES // 4):
        out[first:last] = _score_block(data[places[first] : places[last]], places[first : last + 1] - places[first], table)
    return out


def _score_block(data: np.ndarray, places: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Logits of texts; the words of a long one are scored in stretches, and its windows run over all of them."""
    if len(places) == 2 and len(data) > 4 * tx.BLOCK_BYTES:
        scores = np.concatenate([_stretch_scores(part, table) for part in _stretches(data)])
        return _pooled(scores, np.zeros(len(scores), np.int64), 1)
    starts, owner, buckets, words = _grams(data, places)
    return _pooled(_word_scores(table, buckets, words, len(starts)), owner, len(places) - 1)


def _stretches(data: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in parts of about a block that end between words, however far away that is."""
    first = 0
    while first < len(data):
        last = first + tx.BLOCK_BYTES
        while last < len(data):
            gaps = np.flatnonzero(_CLASS[data[last : last + tx.BLOCK_BYTES]] == 32)
            if len(gaps):
                last += int(gaps[0])
                break
            last += tx.BLOCK_BYTES
        yield data[first:last]
        first = last


def _stretch_scores(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The scores of the words of one stretch; one that reaches over several blocks is summed up piece by piece."""
    if len(data) <= 2 * tx.BLOCK_BYTES:
        starts, _, buckets, words = _grams(data, np.array([0, len(data)]))
        return _word_scores(table, buckets, words, len(starts))
    # a stretch is this long only for a word that crosses its end; others may stand before it
    gaps = np.flatnonzero(_CLASS[data] == 32)
    begin = int(gaps[-1]) + 1 if len(gaps) else 0
    before = _stretch_scores(data[:begin], table) if begin else np.zeros(0)
    word = np.concatenate([[32], _CLASS[data[begin:]], [32]])
    total, count = 0.0, 0
    for at in range(0, len(word), tx.BLOCK_BYTES):
        codes = _CODES[word[at : at + tx.BLOCK_BYTES + max(GRAMS) - 1]]
        run = codes
        for size in range(2, max(GRAMS) + 1):
            run = run[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[size - 1 :]
            if size in GRAMS:
                own = run[: min(tx.BLOCK_BYTES, len(word) - size + 1 - at)] if len(word) - size + 1 > at else run[:0]
                total += table[(tx.mix(own, size) >> np.uint64(64 - 17)).astype(np.int64)].sum()
                count += len(own)
    return np.append(before, total / max(1, count))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic") -> Model:
    """Trains on four fifths of the labelled sample and calibrates the highest window on the rest.

    The sample has up to ``SAMPLE_PER_CLASS`` texts per class of at most ``SAMPLE_MAX_CHARS`` characters each. Without
    labels of both classes the model knows only the share of toxic documents.
    """
    rows, share = labelled.sample(docs, labels, id_col, text_col, label, SAMPLE_PER_CLASS, SAMPLE_MAX_CHARS)
    texts, y = [t.lower().encode() for t, _ in rows], np.array([k for _, k in rows], float)
    number = np.concatenate([np.arange(int((y == k).sum())) for k in (0, 1)]) if len(y) else np.zeros(0)
    rest = number % 5 == 4
    if len(set(y[~rest].tolist())) < 2:
        return Model(None, 0.0, 0.0, share)
    weight = labelled.class_weights(y, 0.5)
    table = _train([t for t, r in zip(texts, rest, strict=True) if not r], y[~rest], weight[~rest])
    check = rest if len(set(y[rest].tolist())) == 2 else ~rest
    z = _logits([t for t, c in zip(texts, check, strict=True) if c], table)
    slope, constant = labelled.logistic(z[:, None], y[check], labelled.class_weights(y[check], share))
    return Model(table, float(slope), float(constant), share)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score)`` for every row, whole texts; a null text is empty, and a row without an id keeps a null id.

    A text without words has no evidence and gets the score of a neutral window.
    """
    tx.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one number per bucket

    def rows(batches) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            if m.table is None:
                out = np.full(batch.num_rows, m.share)
            else:
                data, places = tx.buffers(batch.column("text"))
                z = np.zeros(batch.num_rows)
                for first, last in tx.groups(places, tx.BLOCK_BYTES // 4):
                    z[first:last] = _score_block(data[places[first] : places[last]], places[first : last + 1] - places[first], m.table)
                out = 1 / (1 + np.exp(-np.clip(m.slope * z + m.constant, -30, 30)))
            yield pa.record_batch([batch.column("doc"), pa.array(out)], ["doc_id", "score"])

    plain = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.lower(F.col(text_col).cast("string")).alias("text"))
    return plain.mapInArrow(rows, "doc_id bigint, score double")


def report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` (score of 0.7 or more) for every row of ``docs``."""
    scored = score(docs, fit(docs, labels, id_col, text_col), id_col, text_col)
    return scored.select("doc_id", labelled.is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
