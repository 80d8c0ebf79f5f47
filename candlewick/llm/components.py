"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.llm.shared import few_files, released, stored


def _oriented(edges: DataFrame) -> DataFrame:
    """Each edge once, from the larger to the smaller node, without loops."""
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the smallest node around it."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return _oriented(both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                     .union(edges.join(least, "a").select("a", F.col("m").alias("b"))))


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang every smaller neighbour of a node, and the node, on the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    return _oriented(edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                     .union(least.select("a", F.col("m").alias("b"))))


def _stars(edges: DataFrame) -> bool:
    """Whether each node has either one smaller neighbour or larger ones alone, so that every component hangs on its smallest node."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    other = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or up = 1 and down = 1")
    return other.agg(F.count("*")).first()[0] == 0


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node on an edge; root is the smallest node reachable. edges: (a, b), any order, repeats allowed.

    Each round is written to the shared storage; rounds grow with the logarithm of the longest chain and end with stars. Only a count
    comes to the driver. Null ends are left out; no edges give no rows.
    """
    now = stored(few_files(_oriented(edges.select("a", "b").dropna())), "edges")
    while not _stars(now):
        now = stored(few_files(_small_star(_large_star(now))), "edges")
        released(now.sparkSession)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", F.col("b").alias("root")).distinct())
