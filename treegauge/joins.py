"""Joining many rows with a table of few rows per key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """`rows` with the columns of `table`, which has one or few rows per key.

    `table` usually comes out of an aggregate on the same keys.  Joined as it
    is, its side would keep the aggregate's partitioning, and adaptive
    execution splits a hot key only where both sides were shuffled for the
    join.  A hash of the keys beside the keys themselves gives both sides
    their own exchange: the table's is small, and a key that holds a third of
    `rows` is then split over tasks.  The keys decide what meets; a row with a
    null key meets nothing.  Where the table is small by Spark's own estimate
    it is still broadcast.
    """
    others = [c for c in table.columns if c not in keys]
    left = rows.withColumn("_lookup_hash", F.xxhash64(*keys))
    right = table.select(F.xxhash64(*keys).alias("_lookup_hash_of"),
                         *[F.col(k).alias("_lookup_" + k) for k in keys], *others)
    same = reduce(lambda a, b: a & b, [F.col(k) == F.col("_lookup_" + k) for k in keys],
                  F.col("_lookup_hash") == F.col("_lookup_hash_of"))
    return left.join(right, same, how).drop(
        "_lookup_hash", "_lookup_hash_of", *["_lookup_" + k for k in keys])
