"""Joins against a side that is expected to be small, with the expectation checked."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 200_000


def join_small(rows: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner", max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``small`` when it really has at most ``max_rows`` rows, else join by shuffle.

    Beyond the limit adaptive execution splits the parts of ``rows`` that are skewed; neither side is repeated and
    columns of any type may ride along. ``how`` is inner, left, left_semi or left_anti.
    """
    if small.limit(max_rows + 1).count() <= max_rows:
        return rows.join(F.broadcast(small), list(on), how)
    return rows.join(small, list(on), how)
