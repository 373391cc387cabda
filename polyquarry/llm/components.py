"""Connected components of an edge table, without collecting links or members."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyquarry.llm.common import cut


def components(edges: DataFrame, node: str = "node", root: str = "root") -> DataFrame:
    """``(node, root)`` for every node of ``edges`` (a, b), root the least node of its component.

    Contraction: each round every node points to its least neighbour, pointers are doubled until all lead to
    roots, and edges are rewritten to the roots of their ends; an edge table that gets empty ends it. Each node with an
    edge shares its root with another, so components at least halve: the number of rounds is at most the logarithm of their sizes. Hub nodes only meet joins (split by adaptive execution) and partial
    aggregates, never a collected list of neighbours.
    """
    live = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = cut(live.select(F.col("a").alias(node)).union(live.select("b")).distinct().withColumn(root, F.col(node)))
    while not live.isEmpty():
        both = live.union(live.select("b", "a"))
        joined = cut(both.groupBy(F.col("a").alias("_n")).agg(F.min("b").alias("_m")).select("_n", F.least("_n", "_m").alias("_to")))
        while True:  # pointer doubling: a chain of any length meets its root in a logarithm of steps
            further = joined.select(F.col("_n").alias("_to"), F.col("_to").alias("_on"))
            moved = cut(joined.join(further, "_to", "left").select("_n", F.coalesce("_on", "_to").alias("_to"), (F.col("_on") < F.col("_to")).alias("_moved")))
            joined = moved.select("_n", "_to")
            if moved.where("_moved").isEmpty():
                break
        labels = cut(labels.join(joined, labels[root] == joined["_n"], "left").select(node, F.coalesce("_to", root).alias(root)))
        first = joined.select(F.col("_n").alias("a"), F.col("_to").alias("x"))
        second = joined.select(F.col("_n").alias("b"), F.col("_to").alias("y"))
        moved = live.join(first, "a").join(second, "b").where("x <> y")
        live = cut(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    return labels
