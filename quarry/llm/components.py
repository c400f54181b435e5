"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import dropped, stored


#: Nodes of more than one in so many edges get their least neighbour by broadcast; at most four times as many exist.
HOT = 1000


def _with_least(rows: DataFrame, least: DataFrame, n: int) -> DataFrame:
    """``rows`` (u, v) with the ``m`` of their ``u``; those of hot nodes are not dealt by it. ``least``: u, m, degree."""
    hot = F.broadcast(least.filter(F.col("degree") * HOT > n))
    others = rows.join(hot.select("u"), "u", "left_anti").join(least.filter(F.col("degree") * HOT <= n), "u")
    return rows.join(hot, "u").unionByName(others).select("u", "v", "m")


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Every larger neighbour of a node is linked to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree"))
    least = least.select("u", F.least("u", "m").alias("m"), "degree")
    return _with_least(both.filter("v > u"), least, n).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree"))
    near = _with_least(down, least, n).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.unionByName(least.select("u", F.col("m").alias("v")))


def _state(edges: DataFrame) -> tuple[bool, int]:
    """Whether every node that points down has one edge and none pointing at it, so that no step would change anything;
    and the number of edges."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up"))
    ends = ends.unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    sums = ends.groupBy("x").agg(F.sum("down").alias("down"), F.sum("up").alias("up"))
    no_star, n = sums.agg(F.max(F.expr("down > 1 or (down > 0 and up > 0)")), F.sum("down")).first()
    return not no_star, n or 0


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """``node, component`` (the least node reachable) for all nodes that have a link to another; ``links``: u, v.

    Each star is a group-by with map-side combining and an equi-join, by broadcast for hot nodes; what it yields
    is written to the shared folder, so the lineage stays short. It ends when all edges are stars around the least node,
    which is the fixed point; links that are stars already cost no step.
    """
    edges = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = stored(edges, "cc")
    for _ in range(most):
        done, n = _state(edges)
        if done:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component"))
            ).distinct()
        # rounded down, so that the steps share their generated code; up to twice as many nodes are hot then
        n = 1 << max(0, n.bit_length() - 1)
        large = stored(_large_star(edges, n).filter("u <> v"), "cc-large")
        dropped(edges)
        edges = stored(_small_star(large, n).filter("u <> v").distinct(), "cc")
        dropped(large)
    raise RuntimeError(f"no fixed point after {most} steps")
