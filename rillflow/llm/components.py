"""Connected components by alternating stars, on Spark joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import discard, settled


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 31)))).first())


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of an edge (a, b): root is the smallest node reachable.

    Each round hangs the larger neighbours of every node on its smallest neighbour, then
    the smaller ones; the number of rounds grows with the logarithm of the longest path.
    Minima are combined before they are shuffled, and each round is written to the
    shared folder. Roots themselves are among the nodes.
    """
    edges = settled(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        last, edges = edges, settled(small.unionByName(low.select("a", F.col("low").alias("b"))).distinct())
        discard(last)
        now = _state(edges)
        if now == before:
            break
        before = now
    hung = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return hung.unionByName(hung.select(F.col("root").alias("node"), "root").distinct())
