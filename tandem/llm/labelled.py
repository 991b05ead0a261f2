"""Bounded samples of labelled texts, and one-variable calibration, for the classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label: str, per_class: int, max_chars: int) -> tuple[list[tuple[str, int]], float]:
    """Up to ``per_class`` labelled texts of each class, in the order of a hash of their ids, and the share of class 1.

    Only labels of documents that are not held out are read. An id with several labels has the largest; null labels and
    texts that are null, empty or longer than ``max_chars`` are left out. The sample is the only thing that
    the driver sees: at most ``2 * per_class * max_chars`` characters.
    """
    known = labels.select(F.col(id_col).cast("bigint").alias("doc"), F.col(label).cast("int").alias("y"))
    known = known.filter("doc is not null and y in (0, 1)").filter(~is_held_out(F.col("doc")))
    known = known.groupBy("doc").agg(F.max("y").alias("y"))
    share = known.agg(F.avg("y").alias("share")).first()["share"]
    # some asked ids may lack a usable text
    picked = [known.filter(F.col("y") == y).orderBy(F.xxhash64("doc"), "doc").limit(2 * per_class) for y in (0, 1)]
    picked = F.broadcast(picked[0].unionByName(picked[1]))
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).cast("string").alias("text")).join(picked, "doc")
    texts = texts.filter(F.length("text").between(1, max_chars))
    order = (F.xxhash64("doc"), "doc", "text")
    rows = [r for y in (0, 1) for r in texts.filter(F.col("y") == y).orderBy(*order).limit(per_class).collect()]
    return [(r["text"], r["y"]) for r in rows], 0.5 if share is None else float(share)


def logistic(features: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a logistic regression by Newton's method; the last is the constant."""
    x = np.column_stack([features, np.ones(len(features))])
    beta = np.zeros(x.shape[1])
    penalty = ridge * len(x) * np.eye(x.shape[1])
    penalty[-1, -1] = 1e-9
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + penalty @ beta
        hessian = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + penalty
        step = np.linalg.solve(hessian, gradient)
        beta -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def class_weights(y: np.ndarray, share: float) -> np.ndarray:
    """Weights that give a sample the class shares of the population."""
    ones = max(1, int(y.sum()))
    zeros = max(1, len(y) - ones)
    share = min(max(share, 1e-6), 1 - 1e-6)
    return np.where(y == 1, share / ones, (1 - share) / zeros) * len(y)
