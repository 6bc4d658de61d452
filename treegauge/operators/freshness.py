"""How current each file's content is, and the reports built on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import paths as P, times as T
from ..joins import lookup
from ..schemas import (FILE, FRESH, FRESHNESS_STATES, PENDING_STATES, STALE, UNEMBEDDED,
                       UNREAD)


def per_file(content: DataFrame, catalogue: DataFrame | None,
             vectors: DataFrame) -> DataFrame:
    """`path, state`: unread, else stale, else unembedded, else fresh.

    Without a catalogue nothing can be called stale.  A path the catalogue
    does not hold is stale.  One embedded chunk makes a content embedded, and
    text of white space alone has nothing to embed.  Only narrow columns are
    joined; the text is reduced to one flag first.
    """
    rows = content.select(
        "path", F.col("mtime_ns").alias("read_at"),
        F.coalesce("sha256", F.concat(F.lit("\0"), F.col("path"))).alias("sha256"),
        F.col("reason").isNotNull().alias("unread"),
        F.coalesce(F.rlike("text", F.lit(r"(?U)\S")), F.lit(False)).alias("has_text"))
    if catalogue is None:
        rows = rows.withColumn("stale", F.lit(False))
    else:
        now = catalogue.filter(F.col("kind") == FILE).select("path", "mtime_ns")
        rows = (rows.join(now, "path", "left")
                .withColumn("stale", F.col("mtime_ns").isNull()
                            | (F.col("mtime_ns") != F.col("read_at"))))
    embedded = vectors.select("sha256").distinct().withColumn("embedded", F.lit(True))
    return lookup(rows, embedded, ["sha256"]).select(
        "path", F.when(F.col("unread"), F.lit(UNREAD))
        .when(F.col("stale"), F.lit(STALE))
        .when(F.col("has_text") & F.col("embedded").isNull(), F.lit(UNEMBEDDED))
        .otherwise(F.lit(FRESH)).alias("state"))


def tally(states: DataFrame) -> DataFrame:
    """All four states in one row, zeros included; strangers under `unknown`."""
    return states.agg(
        *[F.count_if(F.col("state") == s).alias(s) for s in FRESHNESS_STATES],
        F.count_if(~F.col("state").isin(*FRESHNESS_STATES)).alias("unknown"))


def pending_by_dir(journal: DataFrame, catalogue: DataFrame, content: DataFrame,
                   in_scope: Column | None = None) -> DataFrame:
    """Files the catalogue saw move that the content layer does not hold."""
    moved = journal.filter(F.col("state").isin(*PENDING_STATES)).select("path")
    if in_scope is not None:
        moved = moved.filter(in_scope)
    files = catalogue.filter(F.col("kind") == FILE).select("path")
    return (moved.join(files, "path", "left_semi")
            .join(content.select("path"), "path", "left_anti")
            .groupBy(P.dirname("path").alias("dir"))
            .agg(F.count(F.lit(1)).alias("pending")))


def per_dir(states: DataFrame, pending: DataFrame | None = None) -> DataFrame:
    """Direct children only, and no roll-up: a parent is not its subtree.

    A directory with nothing but pending files has no row.
    """
    rows = states.groupBy(P.dirname("path").alias("dir")).agg(
        *[F.count_if(F.col("state") == s).alias(s) for s in FRESHNESS_STATES],
        F.count(F.lit(1)).alias("total"))
    rows = rows.withColumn("not_fresh", F.col("total") - F.col(FRESH))
    if pending is None:
        return rows.withColumn("pending", F.lit(0).cast("bigint"))
    return (rows.join(pending, "dir", "left")
            .withColumn("pending", F.coalesce("pending", F.lit(0).cast("bigint"))))


def worst_first(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.desc("not_fresh"), F.desc("pending"), "dir")


def describe_dir(root: str | None = None) -> Column:
    """One line per directory that names the states behind the count."""
    shown = P.relative("dir", root) if root else F.col("dir")
    def part(name: str) -> Column:
        return F.when(F.col(name) > 0, F.concat(F.col(name).cast("string"),
                                                F.lit(" " + name)))
    parts = F.concat_ws(
        ", ", F.concat(F.col(FRESH).cast("string"), F.lit("/"),
                       F.col("total").cast("string"), F.lit(" fresh")),
        part(STALE), part(UNREAD), part(UNEMBEDDED), part("pending"))
    return F.format_string("%-40s %s", shown, parts)


def dir_mixture(states: DataFrame) -> DataFrame:
    """Directories whose direct children are in more than one state."""
    rows = per_dir(states)
    kinds = sum((F.when(F.col(s) > 0, 1).otherwise(0) for s in FRESHNESS_STATES),
                F.lit(0))
    return rows.agg(
        F.sum("total").alias("files"), F.count(F.lit(1)).alias("dirs"),
        F.count_if(kinds > 1).alias("mixed"),
        F.count_if(F.col("not_fresh") > 0).alias("not_fresh_dirs"),
        F.coalesce(F.try_divide(F.count_if(kinds > 1) * 100.0, F.count(F.lit(1))),
                   F.lit(0.0)).alias("pct_mixed"))


# The layers in reading order and the meta key that dates each.
LAYERS = (("catalogue", "l0_scanned_at"), ("content", "last_update"), ("vectors", "embed_at"))


def layer_ages(stamps: DataFrame, now: Column) -> DataFrame:
    """`stamps(store, catalogue, content, vectors, <layer>_open)` to ages.

    Every layer is always named: an age, or which kind of missing.
    """
    def age(layer: str) -> Column:
        opened = F.col(layer + "_open") if layer + "_open" in stamps.columns else F.lit(True)
        return T.described_age(F.col(layer), now, opened)
    ages = stamps.select("store", *[age(layer).alias(layer) for layer, _key in LAYERS])
    return ages.withColumn("line", F.concat_ws("  ", *[
        F.concat(F.lit(layer + " "), F.col(layer)) for layer, _key in LAYERS]))


def status_counts(content: DataFrame, edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """Rows per layer in one line, each side aggregated on its own."""
    n = F.count(F.lit(1))
    return content.agg(
        F.count_if(F.col("reason").isNull()).alias("read"),
        F.count_if(F.col("reason").isNotNull()).alias("unread")).select(
        "read", "unread",
        edges.agg(n).scalar().alias("edges"), vectors.agg(n).scalar().alias("vectors"))
