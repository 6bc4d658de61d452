"""Reciprocal rank fusion of ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window

# The fusion constant, how deep lists are asked, what is shown.
RRF_K = 60
DEPTH = 50
CUT = 10


def positions(ranked: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Rank from 1 within `keys`, a repeated path counting at its first place.

    `ranked` rows have `path`; lists are cut to their depth beforehand, so a
    window partition is one list.
    """
    first = ranked.withColumn(
        "seen", F.row_number().over(Window.partitionBy(*keys, "path").orderBy(*order))
    ).filter(F.col("seen") == 1).drop("seen")
    return first.withColumn(
        "position", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def fuse(ranked: DataFrame, keys: list[str] | None = None, k: int = RRF_K) -> DataFrame:
    """`ranked(list, path, position)` to fused hits with their provenance.

    Score is the sum of 1 / (k + position) over lists, added in list order so
    equal sums are equal doubles; best position decides exact ties.
    """
    keys = keys or []
    merged = ranked.groupBy(*keys, "path").agg(
        F.array_sort(F.collect_list(F.struct("list", "position"))).alias("parts"))
    score = F.aggregate(
        "parts", F.lit(0.0),
        lambda acc, p: acc + F.lit(1.0) / (F.lit(k) + p["position"]).cast("double"))
    return merged.select(
        *keys, "path", score.alias("score"),
        F.array_min(F.transform("parts", lambda p: p["position"])).alias("best"),
        F.map_from_entries("parts").alias("found_by"),
        F.when(F.size("parts") > 1, F.lit("both"))
        .otherwise(F.col("parts")[0]["list"]).alias("route"))


def top(fused: DataFrame, cut: int = CUT) -> DataFrame:
    return fused.orderBy(F.desc("score"), "best", "path").limit(cut)
