"""Connected components of a graph of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialise


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in an edge (a, b); root is the lowest node it is connected with.

    Alternates large-star and small-star, which needs rounds in the order of the logarithm of the nodes.  No step gathers
    the edges of a node: lowest neighbours are aggregates.
    """
    edges = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = _print(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u").select(F.col("v").alias("x"), "m").unionByName(low.select(F.col("u").alias("x"), "m"))
            .where("x <> m").select(F.col("x").alias("u"), F.col("m").alias("v")).distinct()
        )
        done = materialise(small, "edges")
        now = _print(done)
        if now == seen:
            roots = done.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return done.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
        edges, seen = done, now
