"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Every greater neighbour of a node is tied to the node's least neighbour (or itself)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    return both.join(least, both["a"] == least["n"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its lesser neighbours are tied to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
    tied = edges.join(least, edges["a"] == least["n"]).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.unionByName(least.select(F.col("n").alias("a"), F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the nodes of edges (a, b), a > b; root is the least node of the component, and has no row.

    Each round is written to the shared folder, so lineage stays short. The
    number of rounds grows with the logarithm of the longest path. Repeated
    edges count once; ends must not be null; an empty table gives no rows.
    """
    edges = stored(edges.distinct(), "edges")
    while True:
        parents = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
        deep = edges.join(parents.select(F.col("a").alias("b")), "b", "left_semi")
        if not parents.where("n > 1").select(F.lit(1)).unionAll(deep.select(F.lit(1))).take(1):
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        edges = stored(_small_star(_large_star(edges).distinct()).distinct(), "edges")
