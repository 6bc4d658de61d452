"""Questions about the catalogue of paths (metadata only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import paths as P, text as X
from ..joins import lookup
from ..schemas import DIR, FILE


def kind_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("kind").agg(F.count(F.lit(1)).alias("entries"))


def not_denied(files: DataFrame, deny: list[str]) -> DataFrame:
    """Rows outside every denied directory."""
    return files.filter(~P.under_any("path", deny))


def denied_counts(files: DataFrame, deny: list[str]) -> DataFrame:
    hit = P.under_any("path", deny)
    return files.agg(F.count_if(~hit).alias("kept"), F.count_if(hit).alias("pruned"))


def under_root(files: DataFrame, root: str) -> DataFrame:
    return files.filter(P.under("path", root))


def knows(files: DataFrame, root: str) -> bool:
    """Has the catalogue ever seen `root`?  One matching row is enough."""
    return not under_root(files, root).limit(1).isEmpty()


def name_search(files: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Paths that contain every term; shortest first.

    `_` in a term stays a one-character wildcard, as in the LIKE it becomes.
    """
    terms = X.name_terms(query)
    if not terms:
        return files.select("path", "kind").limit(0)
    folded = F.translate(F.col("path"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                         "abcdefghijklmnopqrstuvwxyz")
    matched = F.lit(True)
    for term in terms:
        matched = matched & folded.like("%" + term + "%")
    return (files.filter(matched).select("path", "kind")
            .orderBy(F.length("path"), "path").limit(limit))


def summary_ratio(files: DataFrame, over: int = 32) -> DataFrame:
    """Files per directory: totals, ratio, upper median, share above `over`.

    Directories come from the catalogue's own rows, so an empty one counts.
    The median is read from a histogram of directory sizes, whose length is
    the number of distinct sizes and not the number of directories.
    """
    dirs = files.filter(F.col("kind") == DIR).select(
        F.col("path").alias("dir"), F.lit(0).cast("bigint").alias("n"))
    direct = (files.filter(F.col("kind") == FILE)
              .groupBy(P.dirname("path").alias("dir"))
              .agg(F.count(F.lit(1)).alias("n")))
    sizes = dirs.unionByName(direct).groupBy("dir").agg(F.sum("n").alias("n"))
    return ratio_of(sizes, over)


def ratio_of(sizes: DataFrame, over: int = 32) -> DataFrame:
    """The ratio report over `(dir, n)` rows."""
    histogram = sizes.groupBy("n").agg(F.count(F.lit(1)).alias("dirs"))
    packed = histogram.agg(
        F.sum(F.col("n") * F.col("dirs")).alias("files"),
        F.sum("dirs").alias("dirs"),
        F.sum(F.when(F.col("n") > over, F.col("dirs")).otherwise(0)).alias("dirs_over"),
        F.array_sort(F.collect_list(F.struct("n", "dirs"))).alias("histogram"))
    # Walk the histogram to the element with 0-based index dirs // 2.
    target = F.floor(F.col("dirs") / 2)
    walked = F.aggregate(
        "histogram",
        F.struct(F.lit(0).cast("bigint").alias("seen"),
                 F.lit(None).cast("bigint").alias("median")),
        lambda acc, bin_: F.struct(
            (acc["seen"] + bin_["dirs"]).alias("seen"),
            F.when(acc["median"].isNull() & (acc["seen"] + bin_["dirs"] > target),
                   bin_["n"]).otherwise(acc["median"]).alias("median")))
    return packed.select(
        F.coalesce("files", F.lit(0)).alias("files"),
        F.coalesce("dirs", F.lit(0)).alias("dirs"),
        F.coalesce(F.try_divide(F.col("files"), F.col("dirs")), F.lit(0.0)).alias("ratio"),
        F.coalesce(walked["median"], F.lit(0)).alias("median_files_per_dir"),
        F.coalesce("dirs_over", F.lit(0)).alias("dirs_over"),
        F.coalesce(F.try_divide(F.col("dirs_over") * 100.0, F.col("dirs")),
                   F.lit(0.0)).alias("pct_over"))


def latest_meta(entries: DataFrame) -> DataFrame:
    """Last write wins per (store, key); `entries` carry an increasing `seq`."""
    return entries.groupBy("store", "key").agg(
        F.max_by("value", "seq").alias("value"))


def resolve_project(projects: DataFrame, wanted: str) -> DataFrame:
    """Projects named by id or by exact path, with how many matched."""
    hits = projects.filter((F.col("project_id") == wanted) | (F.col("path") == wanted))
    return hits.groupBy().agg(
        F.count(F.lit(1)).alias("hits"), F.min("project_id").alias("project_id"),
        F.min("path").alias("path"))


def mount_of(files: DataFrame, mounts: DataFrame) -> DataFrame:
    """File system of each path: the longest covering mount, later line on ties.

    `mounts(mount, fstype, line_no)`.  Decided per directory, then joined, so
    the ancestor fan-out never multiplies file rows.
    """
    dirs = files.select(P.dirname("path").alias("dir")).distinct()
    covering = dirs.select(
        "dir", F.explode(F.concat(F.array(F.lit("/")), P.self_and_ancestors("dir")))
        .alias("mount"))
    chosen = (covering.join(mounts, "mount").groupBy("dir")
              .agg(F.max_by("fstype", F.struct(F.length("mount"), "line_no"))
                   .alias("fstype")))
    own = mounts.groupBy(F.col("mount").alias("path")).agg(
        F.max_by("fstype", "line_no").alias("own_fstype"))
    return (lookup(files.select("path", P.dirname("path").alias("dir")), chosen, ["dir"])
            .join(own, "path", "left")
            .select("path", F.coalesce("own_fstype", "fstype").alias("fstype")))
