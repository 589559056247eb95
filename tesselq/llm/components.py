"""Connected components of a graph held in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root) for nodes(node) and edges(a, b): root is the smallest node that edges reach.

    Each round hooks every component that an edge leaves to the smallest it touches, and follows hooks to their ends
    by doubling. Rounds are few: the log of the longest path at most. Tables are written between rounds, so lineage
    stays short, nothing gathers on the driver, and both sides of each join are tables that Spark can split.
    """
    edges = written(edges.select("a", "b").where("a <> b").distinct(), "edges")
    labels = written(nodes.select("node", F.col("node").alias("root")), "labels")
    while True:
        left = labels.select(F.col("node").alias("a"), F.col("root").alias("root_a"))
        right = labels.select(F.col("node").alias("b"), F.col("root").alias("root_b"))
        crossing = edges.join(left, "a").join(right, "b").where("root_a <> root_b")
        hooks = crossing.select(F.greatest("root_a", "root_b").alias("from"), F.least("root_a", "root_b").alias("to"))
        hooks = written(hooks.groupBy("from").agg(F.min("to").alias("to")), "hooks")
        if hooks.isEmpty():
            return labels
        while True:
            ends = hooks.select(F.col("from").alias("to"), F.col("to").alias("end"))
            hooks = written(hooks.join(ends, "to", "left").select("from", F.coalesce("end", "to").alias("to"), F.col("end").isNotNull().alias("moved")), "hooks")
            if hooks.where("moved").isEmpty():
                break
            hooks = hooks.select("from", "to")
        moves = hooks.select(F.col("from").alias("root"), "to")
        labels = written(labels.join(moves, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "labels")
