"""Connected components of an edge list, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: A node with more than a SHARE of all edges, and more than LEAST, is a hub; there are 2 / SHARE hubs at most.
SHARE, LEAST = 1e-4, 100


def with_least(edges: DataFrame, least: DataFrame, hub: int | None) -> DataFrame:
    """edges (a, b) with m, the least node that a sees.

    least: (a, m, of), of the node's number of edges. The few hubs, if there are any, are broadcast, so that no hub's edges
    meet in one task; other nodes are joined by key."""
    if hub is None:
        return edges.join(least.select("a", "m"), "a")
    few = F.broadcast(least.where(F.col("of") > hub).select(F.col("a").alias("hub"), F.col("m").alias("hub_m")))
    at = edges.join(few, F.col("a") == F.col("hub"), "left")
    rest = at.where("hub IS NULL").select("a", "b").join(least.where(F.col("of") <= hub).select("a", "m"), "a")
    return rest.select("a", "b", "m").unionByName(at.where("hub IS NOT NULL").select("a", "b", F.col("hub_m").alias("m")))


def looked_at(edges: DataFrame) -> tuple[int, int, int]:
    """(edges, the most edges of a node, nodes that keep the edges from being stars: with two upper ends, or with both kinds of ends)."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))))
    nodes = edges.select(ends.alias("x")).groupBy("x.node").agg(F.sum("x.up").alias("up"), F.sum("x.down").alias("down"))
    bad = (F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))
    return tuple(int(x or 0) for x in nodes.agg(F.sum("up"), F.max(F.col("up") + F.col("down")), F.count_if(bad)).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, label): for every node of the edges (a, b) the smallest node of its component.

    Each round links every node to the smallest one it sees; every round's edges are written to the shared folder, until
    they are stars. Nodes without an edge don't appear; loops and repeated edges are harmless; a hub's edges are never
    gathered."""
    e = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while True:
        n, most, bad = looked_at(e)
        if not bad:
            break
        limit = max(LEAST, int(n * SHARE))
        hub = limit if most > limit else None
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("of"))
        large = with_least(both.where("b > a"), least, hub).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("of"))
        small = with_least(large, least, hub).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        e = cut(small.where("a <> b").distinct())
    return e.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
