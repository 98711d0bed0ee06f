"""Connected components by rounds of label exchange on narrow tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitgrain.session import written


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)``: the smallest node of its component, for each node of ``(a, b)`` edges.

    Alternates two steps until no edge changes: each node's larger neighbours
    move to its smallest neighbour, then its smaller ones do. Each step keeps
    the components and a row for each edge at most; the rounds grow with the
    logarithm of the nodes. Null ends are dropped, an edge from a node to
    itself only names the node. An empty table has no components.
    """
    edges = written(
        edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = written(large, "large-star")
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(small_least, "a")
        small = moved.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        small = written(small.where(F.col("a") != F.col("b")).distinct(), "small-star")
        if same(small, edges):
            break
        edges = small
    return small.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(small.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def same(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables of distinct edges are equal, by their size and an exact-sum digest."""
    def digest(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())

    return digest(a) == digest(b)
