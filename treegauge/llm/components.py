"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from treegauge.joins import lookup
from treegauge.session import for_one_action

from .common import settle

#: More rounds than any graph of 2^60 nodes needs.
ROUNDS = 64


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of `edges` (a, b): the least node it reaches.

    Each step hangs a node's neighbours on the least of them; the number of
    rounds grows with the logarithm of the longest chain.  Minima combine
    before the shuffle, and a hub's edges are split over tasks (`lookup`).
    Loops and repeated edges do no harm; no edges give no rows.
    """
    now = settle(_downward(edges.select(F.col("a").cast("long"), F.col("b").cast("long"))))
    before = None
    for _ in range(ROUNDS):
        state = for_one_action(now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")),
                                       F.sum(F.col("b").cast("decimal(38,0)")))).collect()
        if state == before:
            break
        before = state
        now = settle(_small_star(_large_star(now)))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _downward(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return lookup(both, least, ["a"], "inner").where("b > a").select(
        F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    hung = lookup(edges, least, ["a"], "inner").where("b <> m").select(
        F.col("b").alias("a"), F.col("m").alias("b"))
    return _downward(hung.unionByName(least.select("a", F.col("m").alias("b"))))
