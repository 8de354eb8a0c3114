"""Connected components of an edge table, as joins and aggregates.

Alternating star contraction: large-star hangs every larger neighbour of a node on the node's
smallest neighbour, small-star hangs every smaller one and the node itself. Both keep the
components, and repeating them leaves a star around the smallest node of each. Each round is
written to the shared folder, so its lineage ends there and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of all nodes of ``edges(a, b)``; the root is the smallest node."""
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    stars = materialize(pairs.distinct(), "edges")
    state = None
    while True:
        seen = stars.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")
        ).head()
        if (seen.n, seen["sum"]) == state:
            break
        state = (seen.n, seen["sum"])
        stars = materialize(small_star(large_star(stars)), "edges")
    hung = stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return hung.unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def dealt_anew(smallest: DataFrame) -> DataFrame:
    """The small table, no longer partitioned by node.

    Else the join would run on the partitions of the aggregate, where adaptive execution cannot
    split a node with very many neighbours.
    """
    return smallest.repartition(max(1, smallest.sparkSession.sparkContext.defaultParallelism))


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    smallest = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root"))
    joined = both.join(dealt_anew(smallest), both["a"] == F.col("node")).where(F.col("b") > F.col("a"))
    return joined.select(F.col("b").alias("a"), F.col("root").alias("b")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    smallest = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    joined = edges.join(dealt_anew(smallest), edges["a"] == F.col("node"))
    hung = joined.select(F.col("b").alias("a"), F.col("root").alias("b")).where("a <> b")
    return hung.unionByName(smallest.select(F.col("node").alias("a"), F.col("root").alias("b"))).distinct()
