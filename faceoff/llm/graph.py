"""Connected components of an edge table, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faceoff.llm.scratch import Scratch


def _loose(edges: DataFrame) -> DataFrame:
    """Undirected edges once each, without loops."""
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(v, root) for every node of ``edges`` (a, b: long, not null); root is the smallest node reachable.

    Each round hooks every node to its smallest neighbour, follows the pointers to their ends by doubling,
    and contracts the edges to those ends; the edges at least halve in a round, so rounds grow with the
    logarithm of the nodes. Only tables pass between rounds. A node of many edges costs one pre-aggregated
    row per task in the hooking; the joins are on single nodes, whose large sides Spark can split.
    """
    nodes = None
    rest = scratch.keep(_loose(edges))
    while not rest.isEmpty():
        both = rest.union(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = scratch.keep(both.groupBy(F.col("a").alias("v")).agg(F.least(F.first("a"), F.min("b")).alias("root")))
        while True:
            # the nodes that point at one which points on
            on = point.where("v <> root").select(F.col("v").alias("root"), F.col("root").alias("next"))
            moved = scratch.keep(point.join(on, "root", "left").select("v", F.coalesce("next", "root").alias("root"),
                                                                        F.col("next").isNotNull().alias("moved")))
            again = not moved.where("moved").isEmpty()
            scratch.drop(point)
            point = moved
            if not again:
                break
        point = point.select("v", "root")
        if nodes is None:
            merged = point
        else:
            merged = scratch.keep(nodes.withColumnRenamed("root", "m").join(
                point.select(F.col("v").alias("m"), "root"), "m", "left").select("v", F.coalesce("root", "m").alias("root")))
        shorter = scratch.keep(_loose(
            rest.join(point.select(F.col("v").alias("a"), F.col("root").alias("x")), "a")
            .join(point.select(F.col("v").alias("b"), F.col("root").alias("y")), "b")
            .select(F.col("x").alias("a"), F.col("y").alias("b"))))
        scratch.drop(rest)
        nodes, rest = merged, shorter
    return rest.select(F.col("a").alias("v"), F.col("b").alias("root")) if nodes is None else nodes
