"""Joins on keys that may hold a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key with more than one in so many of all rows counts as hot, so there are at most so many hot keys.
HOT_KEYS = 1000


def join_hot(rows: DataFrame, keyed: DataFrame, keys: Sequence[str], count: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``keyed``, one row per key whose column ``count`` says how many of ``total`` rows it has.

    Rows of hot keys stay where they are and get their match from a broadcast of at most ``HOT_KEYS`` rows; all
    others are joined as usual.
    """
    hot = keyed.filter(F.col(count) * HOT_KEYS > total)
    rest = rows.join(F.broadcast(hot.select(*keys)), list(keys), "left_anti")
    return rows.join(F.broadcast(hot), list(keys)).unionByName(rest.join(keyed.filter(F.col(count) * HOT_KEYS <= total), list(keys)))
