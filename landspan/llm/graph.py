"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landspan.llm.store import save


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def mark(edges: DataFrame) -> tuple:
    """Equal for equal sets of edges: their number and sums of their hashes."""
    h = F.xxhash64("a", "b").cast("decimal(38,0)")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(h), F.sum(F.xxhash64(F.lit(1), "b", "a").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node reachable, for every node that has an edge (a, b), a <> b.

    Each round links every node's larger neighbours to its smallest one, then its smaller
    ones; edges turn into stars around the smallest nodes.  The smallest neighbour is a
    partial aggregate, so a node with very many edges needs no place of its own.  Every
    round is a table in the shared folder.
    """
    edges = save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        near = _both(edges)
        least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = near.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        after = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = save(after.union(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        if mark(after) == mark(edges):
            break
        edges = after
    roots = edges.select(F.col("b").alias("a"), "b").distinct()
    return edges.union(roots).distinct().select(F.col("a").alias("node"), F.col("b").alias("label"))
