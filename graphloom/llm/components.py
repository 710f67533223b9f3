"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.shared import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of the undirected edges (a, b); component is the smallest node reachable.

    Each round is a pair of partial aggregates and joins; the edge table of a round
    goes to the shared folder, so lineage stays short. Self-edges are ignored and
    an empty edge table gives an empty result.
    """
    now = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = _mark(now)
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b"), F.col("a")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = stored(small.union(least.select("a", "m")).distinct(), "edges")
        last, mark = mark, _mark(now)
        if last == mark:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
