"""Connected components of a large graph, as DataFrame operations with cut lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.shared import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (a, b: long): the smallest node that can be reached.

    Each round hooks every node to its smallest neighbour, if that is smaller, follows the hooks twice, and contracts
    the edges; those within a component go. Chains halve at least, so the rounds grow with the logarithm of the longest.
    Edges from a node to itself, and repeated ones, do nothing.
    """
    left = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    nodes = left.select(F.col("a").alias("node")).union(left.select("b")).distinct().withColumn("component", F.col("node"))
    while not left.isEmpty():
        # a < b, so the smaller neighbours of b are its a
        hooks = materialize(left.groupBy(F.col("b").alias("of")).agg(F.min("a").alias("to")), "hooks")
        for _ in range(2):
            on = hooks.select(F.col("of").alias("to"), F.col("to").alias("further"))
            hooks = hooks.join(on, "to", "left").select("of", F.coalesce("further", "to").alias("to"))
        hooks = materialize(hooks, "hooks")
        moved = lambda df, c, hooks=hooks: df.join(hooks.withColumnRenamed("of", c), c, "left").withColumn(c, F.coalesce("to", c)).drop("to")
        nodes = materialize(moved(nodes, "component").select("node", "component"), "nodes")
        ends = moved(moved(left, "a").select("a", "b"), "b").where("a <> b")
        left = materialize(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    return nodes
