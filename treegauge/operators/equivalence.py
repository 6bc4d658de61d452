"""Do two stores say the same?  Compared as sets, axis by axis."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

# Meta keys that are facts about a run and not about the state.
RUN_FACTS = ("project_id", "l0_scanned_at", "last_update", "embed_at", "l0_seconds")

PROJECT_AXES = {
    "content": ("content", ("path", "sha256", "reason")),
    "edges": ("edges", ("src", "dst", "kind", "method", "confidence")),
    "scope": ("scope", ("path", "mode")),
    "index": ("index", ("path",)),
    "vectors": ("vectors", ("sha256", "ord")),
    "vector_values": ("vectors", ("sha256", "ord", "vector")),
    "meta": ("meta", ("key", "value")),
}
CATALOGUE_AXES = {
    "files": ("files", ("path", "kind", "size", "mtime_ns")),
    "hashes": ("files", ("path", "content_hash")),
    "meta": ("meta", ("key", "value")),
}


def _keyed(layer: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """One comparable string per row; NULL and empty stay different."""
    if columns == ("key", "value"):
        layer = layer.filter(~F.col("key").isin(*RUN_FACTS))
    return layer.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("key"))


def differences(left: dict[str, DataFrame], right: dict[str, DataFrame],
                axes: dict = PROJECT_AXES) -> DataFrame:
    """`axis, key, side` for everything only one store has.

    Both stores go through one aggregate: a row seen on one side only is a
    difference.  An empty answer is the claim of equivalence.
    """
    rows = []
    for side, store in (("a", left), ("b", right)):
        for axis, (layer, columns) in axes.items():
            if layer in store:
                rows.append(_keyed(store[layer], columns).select(
                    F.lit(axis).alias("axis"), "key", F.lit(side).alias("side")))
    seen = reduce(DataFrame.unionByName, rows)
    return (seen.groupBy("axis", "key")
            .agg(F.min("side").alias("first"), F.max("side").alias("last"))
            .filter(F.col("first") == F.col("last"))
            .select("axis", "key", F.concat(F.lit("only_in_"), F.col("first")).alias("side")))


def summary(diff: DataFrame) -> DataFrame:
    return diff.groupBy("axis").agg(
        F.count_if(F.col("side") == "only_in_a").alias("only_in_a"),
        F.count_if(F.col("side") == "only_in_b").alias("only_in_b"))
