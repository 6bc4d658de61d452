"""The content layer: what each in-scope file holds, or why it was not read."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..joins import lookup
from ..functions.content import MAX_BYTES, sha256_hex, unread_reason


def classify(raw: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """`raw(path, size, mtime_ns, bytes)` to the content layer, row by row.

    Exactly one of `reason` and `text` is set on every row.
    """
    judged = raw.withColumn("reason", unread_reason(F.col("size"), F.col("bytes"),
                                                    max_bytes))
    readable = F.col("reason").isNull()
    return judged.select(
        "path", "size", "mtime_ns",
        F.when(readable, sha256_hex(F.col("bytes"))).alias("sha256"),
        F.when(readable, F.col("bytes").cast("string")).alias("text"), "reason")


def tally(content: DataFrame) -> DataFrame:
    """Read and unread rows, and unread rows by reason, as `(name, n)`."""
    names = F.when(F.col("reason").isNull(), F.array(F.lit("read"))).otherwise(
        F.array(F.lit("unread"), F.col("reason")))
    return (content.select(F.explode(names).alias("name"))
            .groupBy("name").agg(F.count(F.lit(1)).alias("n")))


def broken_rows(content: DataFrame) -> DataFrame:
    """Rows that break the layer's invariant; always empty when it holds."""
    return content.filter(F.col("reason").isNull() != F.col("text").isNotNull())


def nodes(content: DataFrame) -> DataFrame:
    """Distinct content hashes: the nodes of the graph."""
    return content.filter(F.col("sha256").isNotNull()).select("sha256").distinct()


def node_paths(content: DataFrame) -> DataFrame:
    """Every (node, path) with the number of paths the node has.

    Rows rather than one list per node: copies of one file may be a third of
    the corpus.  The count is aggregated first and joined back.
    """
    rows = content.filter(F.col("sha256").isNotNull()).select("sha256", "path")
    counted = rows.groupBy("sha256").agg(F.count(F.lit(1)).alias("n_paths"))
    return lookup(rows, counted, ["sha256"], "inner")


def paths_of(content: DataFrame, node: str) -> DataFrame:
    return content.filter(F.col("sha256") == node).select("path").orderBy("path")


def move_paths(content: DataFrame, old: str, new: str) -> DataFrame:
    """Paths rewritten after a project moved; hashes and text untouched."""
    from ..functions.paths import moved

    return content.withColumn("path", moved("path", old, new))
