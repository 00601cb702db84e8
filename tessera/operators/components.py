"""Connected components of a graph given as edges, by contraction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def connected_components(edges: DataFrame, cut: Callable[[DataFrame], DataFrame], jumps: int = 2) -> DataFrame:
    """(node, component) of every node of `edges` (a, b); the component is its smallest node.

    Each round hooks every node to its smallest neighbour, shortens the chains that makes, renames the edges' ends and drops
    those inside one component. Edges shrink in every round, so rounds are few. `cut` must compute a frame and cut its
    lineage (a checkpoint in a shared folder). Edges with a null end are ignored; loops keep their node.
    """
    edges = edges.where("a is not null and b is not null")
    nodes = cut(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct())
    rest = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    found = nodes.withColumn("component", F.col("node"))
    while not rest.isEmpty():
        both = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("n"), F.least("a", "b").alias("p"))
        for _ in range(jumps):
            up = hook.select(F.col("n").alias("p"), F.col("p").alias("q"))
            hook = cut(hook.join(up, "p").select("n", F.col("q").alias("p")))
        rest = rest.join(hook.select(F.col("n").alias("a"), F.col("p").alias("x")), "a").select("b", "x")
        rest = rest.join(hook.select(F.col("n").alias("b"), F.col("p").alias("y")), "b").where("x <> y")
        rest = cut(rest.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
        named = hook.select(F.col("n").alias("component"), F.col("p").alias("to"))
        found = cut(found.join(named, "component", "left").select("node", F.coalesce("to", "component").alias("component")))
    return found
