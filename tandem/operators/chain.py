"""Replays where each accepted operation decides which one is accepted next.

Once it is known for every operation which one would follow if it succeeded, the accepted operations are
the path from the start. Keys that fit one task are walked there. A hot key is cut into chunks: chunks are
reduced to "entered here, left there", the path over those entries is found by doubling (a logarithmic
number of joins), and each chunk then walks its own part.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.operators.scan import CHUNK, HotKeys, find_hot_keys, with_chunk
from tandem.session import shared_dir


def _successors(ids: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Place of each row's successor among the sorted ``ids``, -1 when it lies elsewhere; -1 marks none."""
    place = np.searchsorted(ids, following)
    inside = (place < len(ids)) & (following >= 0)
    inside[inside] = ids[place[inside]] == following[inside]
    return np.where(inside, place, -1)


def _path(nexts: np.ndarray, start: int) -> np.ndarray:
    """The places on the path from ``start``: each round finds as many as are known, while jumps double."""
    reached, jump = np.array([start]), nexts
    while True:
        fresh = jump[reached]
        fresh = fresh[fresh >= 0]
        if not len(fresh):
            return reached
        reached = np.concatenate([reached, fresh])
        jump = np.where(jump >= 0, jump[jump], -1)


def _ends(nexts: np.ndarray) -> np.ndarray:
    """The last place on the path from each place, with paths halved in every round."""
    at = np.where(nexts >= 0, nexts, np.arange(len(nexts)))
    while True:
        onward = at[at]
        if np.array_equal(onward, at):
            return at
        at = onward


def _walk(pdf: pd.DataFrame, key: str) -> pd.DataFrame:
    """The rows on the path that enters this group at ``start``."""
    pdf = pdf.sort_values("id")
    ids = pdf["id"].to_numpy()
    path = _path(_successors(ids, pdf["next"].to_numpy()), int(np.searchsorted(ids, pdf["start"].iloc[0])))
    return pd.DataFrame({key: pdf[key].iloc[0], "id": ids[path]})


def _exits(pdf: pd.DataFrame, key: str) -> pd.DataFrame:
    """Where the path through each entered row leaves this group."""
    pdf = pdf.sort_values("id")
    ids, nexts = pdf["id"].to_numpy(), pdf["next"].to_numpy()
    leaves = nexts[_ends(_successors(ids, nexts))]
    out = pd.DataFrame({key: pdf[key].iloc[0], "id": ids, "next": leaves})
    return out[pdf["entered"].to_numpy()]


def follow(nodes: DataFrame, key: str, hot: HotKeys | None = None) -> DataFrame:
    """The (key, id) on the path of each key, from its lowest id along ``next``.

    ``nodes`` has BIGINT ``id`` (unique per key) and ``next``, a later id of the same key or NULL.
    """
    nodes = nodes.select(key, "id", F.coalesce("next", F.lit(-2)).alias("next"))
    hot = hot or find_hot_keys(nodes, [key], "id")
    roots = nodes.groupBy(key).agg(F.min("id").alias("id"))
    schema = f"{key} {dict(nodes.dtypes)[key]}, id bigint"
    if not hot.found:
        started = nodes.join(roots.withColumnRenamed("id", "start"), key)
        return started.groupBy(key).applyInPandas(lambda pdf: _walk(pdf, key), schema)

    chunked = with_chunk(nodes, hot)
    group = [key, CHUNK]
    entries = roots.unionByName(_crossing(nodes, hot).select(key, F.col("next").alias("id"))).distinct()
    flagged = chunked.join(entries.withColumn("entered", F.lit(True)), [key, "id"], "left").fillna(False, ["entered"])
    edges = flagged.groupBy(*group).applyInPandas(lambda pdf: _exits(pdf, key), f"{schema}, next bigint")
    reached = _double(edges, roots, key)
    # a path enters a chunk once, so its entries are one row per chunk
    starts = with_chunk(reached, hot).groupBy(*group).agg(F.min("id").alias("start"))
    return chunked.join(starts, group).groupBy(*group).applyInPandas(lambda pdf: _walk(pdf, key), schema)


def _crossing(nodes: DataFrame, hot: HotKeys) -> DataFrame:
    """Rows of hot keys whose successor lies in another chunk."""
    here = with_chunk(nodes.filter("next >= 0"), hot).withColumnRenamed(CHUNK, "_here")
    there = with_chunk(here, replace(hot, by="next"))
    return there.filter(F.col("_here") != F.col(CHUNK))


def _double(edges: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    """All ids on the paths from ``roots``: reach doubles per round, so rounds grow with log(length).

    Every round ends in a reliable checkpoint, which also lets a lost executor be replaced.
    """
    shared_dir(edges.sparkSession)
    jump = edges.filter("next >= 0").checkpoint()
    reached = roots.checkpoint()
    while True:
        fresh = reached.join(jump, [key, "id"]).select(key, F.col("next").alias("id")).checkpoint()
        if fresh.isEmpty():
            return reached
        reached = reached.unionByName(fresh).checkpoint()
        onward = jump.select(key, F.col("id").alias("next"), F.col("next").alias("beyond"))
        jump = jump.join(onward, [key, "next"]).select(key, "id", F.col("beyond").alias("next")).checkpoint()
