"""Connected components of a table of links, by star contraction with written tables between rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.session import discard, stored

# Links of one task; fewer links than this need no shuffle at all.
LINKS_PER_PART = 200_000


def gathered(table: DataFrame, rows_per_part: int = LINKS_PER_PART) -> DataFrame:
    """A written table in no more partitions than its rows ask for: tables of one partition are joined and grouped without a shuffle.

    Joined with a table of several partitions it is dealt out like any other.
    """
    out = table.coalesce(max(1, -(-table.count() // rows_per_part)))
    out.stored_at = table.stored_at
    return out


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _both_ways(edges: DataFrame) -> DataFrame:
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    return edges.select(F.explode(ways).alias("way")).select("way.a", "way.b")


def components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` of nodes to ``(node, component)``, where the component is its smallest node.

    Large stars hang the larger neighbours of a node on the smallest one, small stars the smaller ones, until
    nothing changes; a round is two joins on aggregated minima, so a node with many links is not gathered
    anywhere. Rounds run in as many tasks as the count of links asks for. Only nodes with a link to another node
    are returned.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
    edges = stored(edges, "links")
    seen = _digest(edges)
    parts = max(1, -(-seen[0] // LINKS_PER_PART))
    while True:
        both = _both_ways(edges.coalesce(parts))
        lowest = both.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("low", "a"))
        large = both.join(lowest, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a > b").distinct()
        large = stored(large, "large-star")
        lowest = large.coalesce(parts).groupBy("a").agg(F.min("b").alias("low"))
        hung = large.coalesce(parts).join(lowest, "a")
        hung = hung.select(F.explode(F.array("a", "b")).alias("a"), F.col("low").alias("b"))
        small = stored(hung.filter("a > b").distinct(), "small-star")
        discard(edges, large)
        edges, now = small, _digest(small)
        if now == seen:
            break
        seen = now
    roots = F.explode(F.array("a", "b"))
    return edges.coalesce(parts).select(roots.alias("node"), F.col("b").alias("component")).distinct()


def extend(groups: DataFrame, links: DataFrame) -> DataFrame:
    """The components after more written ``links(a, b)``, given those so far: only links between them are followed."""
    links = gathered(links)
    left = groups.select(F.col("node").alias("a"), F.col("component").alias("a_c"))
    right = groups.select(F.col("node").alias("b"), F.col("component").alias("b_c"))
    between = links.join(left, "a", "left").join(right, "b", "left")
    between = between.select(F.coalesce("a_c", "a").alias("a"), F.coalesce("b_c", "b").alias("b"))
    merged = gathered(stored(components(between), "merged"))
    moved = merged.select(F.col("node").alias("component"), F.col("component").alias("moved"))
    old = groups.join(moved, "component", "left").select("node", F.coalesce("moved", "component").alias("component"))
    return old.unionByName(merged.join(groups, "node", "left_anti"))
