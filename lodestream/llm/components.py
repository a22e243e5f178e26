"""Connected components by alternating large-star and small-star steps, each a join and a grouped minimum.

Every step is written to the shared folder, so that a lost executor costs one step. A node of very many edges
is met as a skewed join of two stored tables, which adaptive execution splits, and as a minimum that is
combined before its shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lodestream.llm.shared import discard, stored


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hangs its larger neighbours on the smallest node it sees."""
    both = _both(edges)
    least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    out = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return stored(out.filter("u <> v").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node hangs itself and its smaller neighbours on the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = stored(down.groupBy("u").agg(F.min("v").alias("m")))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return stored(moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, component) for every node that has an edge and isn't itself the smallest of its component.

    edges: columns u and v (long). Loops, repeated edges and both directions of an edge are allowed; rows with a
    null end are ignored. No edges: no rows. component is the smallest node reachable.
    """
    now = stored(edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).filter("u <> v").distinct())
    mark = _mark(now)
    while mark[0]:
        large = _large_star(now)
        small = _small_star(large)
        discard(large)
        after = _mark(small)
        discard(now)
        now = small
        if after == mark:
            break
        mark = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
