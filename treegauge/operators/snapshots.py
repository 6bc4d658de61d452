"""Which snapshots to keep, and which projects are about to lose their last."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, functions as F, Window

from ..functions.times import days_between

# Days kept, how many a living project always keeps, warning.
RETAIN_DAYS = 14
RETAIN_FLOOR = 3
WARN_DAYS = 2

#: What a read can fail with: Spark's own conditions, and jobs that were aborted.
FAILURES = (PySparkException, Py4JJavaError)
#: How Spark names a file that is gone or does not read as what it was.
DAMAGE = ("PATH_NOT_FOUND", "FAILED_READ_FILE", "UNABLE_TO_INFER_SCHEMA")


def newest(snapshots: DataFrame, keep: int) -> DataFrame:
    """The `keep` newest snapshots per project.

    A row-number filter against a constant is applied before the shuffle as
    well, so a project with millions of snapshots sends a handful per task.
    """
    order = Window.partitionBy("project_id").orderBy(
        F.desc("taken_at"), F.desc("snapshot_id"))
    return (snapshots.withColumn("newest_no", F.row_number().over(order))
            .filter(F.col("newest_no") <= keep))


def retention(snapshots: DataFrame, now: Column) -> DataFrame:
    """Every snapshot with `keep`: young, or protected as one of the newest.

    `snapshots(project_id, snapshot_id, taken_at, living)`; only living
    projects have a protected floor.
    """
    floor = newest(snapshots.filter("living"), RETAIN_FLOOR).select(
        "project_id", "snapshot_id", F.lit(True).alias("protected"))
    young = days_between(now, F.col("taken_at")) <= RETAIN_DAYS
    return (snapshots.join(floor, ["project_id", "snapshot_id"], "left")
            .withColumn("keep", young | F.coalesce("protected", F.lit(False)))
            .drop("protected"))


def expiring(snapshots: DataFrame, now: Column, within: float = WARN_DAYS) -> DataFrame:
    """Deleted projects whose oldest snapshot is about to go: `project_id, days_left`."""
    oldest = (snapshots.filter(~F.col("living")).groupBy("project_id")
              .agg(F.min("taken_at").alias("oldest")))
    left = F.lit(float(RETAIN_DAYS)) - days_between(now, F.col("oldest"))
    return (oldest.select("project_id", left.alias("days_left"))
            .filter(F.col("days_left") <= within).orderBy("days_left", "project_id"))


def restorable(copies: DataFrame) -> DataFrame:
    """The newest snapshot per project that verifies, not simply the newest."""
    return (copies.filter("intact").groupBy("project_id")
            .agg(F.max_by("snapshot_id", F.struct("taken_at", "snapshot_id"))
                 .alias("snapshot_id"), F.max("taken_at").alias("taken_at")))


def digest(layer: DataFrame) -> str:
    """Rows of a layer and two order-free sums of their hashes, nulls told from their place.

    Partial sums merge, so no task holds a layer; a row that is twice there
    counts twice.
    """
    cells = [F.col("`%s`" % c.replace("`", "``")) for c in layer.columns]
    cells += [c.isNull() for c in cells]
    one, other = F.xxhash64(F.lit(1), *cells), F.xxhash64(F.lit(2), *cells)
    found = layer.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(one.cast("decimal(20,0)")), F.lit(0)).alias("a"),
                      F.coalesce(F.sum(other.cast("decimal(20,0)")), F.lit(0)).alias("b")).first()
    return "%d:%d:%d" % (found["n"], found["a"], found["b"])


def is_damage(problem: Exception) -> bool:
    """Files are gone or unreadable; a lost executor or a stopped job says nothing about them."""
    told = str(problem)
    return any("[" + name in told for name in DAMAGE)


#: A version is store, layer and time; an index keeps two tables below its version.
_VERSION = r"([^/]+/[^/]+/[0-9]+)"


def named_versions(meta: DataFrame) -> DataFrame:
    """`version` of every layer a living pointer or a kept snapshot names.

    `meta(store, key, value)` holds the latest facts.
    """
    frozen = F.startswith("store", F.lit("snapshot:"))
    dropped = meta.filter(frozen & (F.col("key") == "dropped")).select("store")
    key = F.when(frozen, F.regexp_extract("key", "^was:(.*)", 1)).otherwise(F.col("key"))
    points = meta.filter(F.startswith(key, F.lit("layer:")) | (key == "index"))
    return (points.join(dropped, "store", "left_anti")
            .select(F.regexp_extract("value", _VERSION + "/*$", 1).alias("version"))
            .filter(F.col("version") != "").distinct())


def unnamed_versions(files: DataFrame, meta: DataFrame) -> DataFrame:
    """`version` of what is stored and named by nothing any more; `files(path)` are all stored files."""
    stored = files.select(F.regexp_extract("path", _VERSION + "/(?:postings/|lengths/)?[^/]+$", 1).alias("version"))
    return stored.filter(F.col("version") != "").distinct().join(named_versions(meta), "version", "left_anti")
