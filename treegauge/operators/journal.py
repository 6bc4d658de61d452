"""What moved between two catalogue passes, and what is still unhashed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..schemas import (ADDED, BACKFILLED, CHANGED, COMPARED, FILE, JOURNAL_STATES,
                       REMOVED, TOUCHED, UNCHANGED, UNCONFIRMED)
from .. import Refused


def moved(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of the new pass that are new or whose size or mtime differ.

    This is the residual worth opening: hash these paths, nothing else.
    """
    before = old.select("path", F.col("size").alias("old_size"),
                        F.col("mtime_ns").alias("old_mtime"), F.lit(True).alias("seen"))
    return (new.join(before, "path", "left")
            .filter(F.col("seen").isNull() | (F.col("size") != F.col("old_size"))
                    | (F.col("mtime_ns") != F.col("old_mtime")))
            .select(*new.columns))


def compare(old: DataFrame, new: DataFrame) -> DataFrame:
    """The journal plus the carried hashes, from one full outer join.

    `old(path, size, mtime_ns, content_hash, hash_source)`;
    `new(path, kind, size, mtime_ns, in_scope, hash_now)` where `hash_now` is
    NULL for files that were not, or could not be, read.

    A row whose old hash is kept keeps its source too, and no hash means no
    source.
    """
    o = old.select("path", F.lit(True).alias("in_old"), F.col("size").alias("o_size"),
                   F.col("mtime_ns").alias("o_mtime"),
                   F.col("content_hash").alias("o_hash"),
                   F.col("hash_source").alias("o_source"))
    n = new.select("path", F.lit(True).alias("in_new"), "size", "mtime_ns",
                   F.when((F.col("kind") == FILE) & F.col("in_scope"),
                          F.col("hash_now")).alias("h"))
    same = (F.col("size") == F.col("o_size")) & (F.col("mtime_ns") == F.col("o_mtime"))
    state = (F.when(F.col("in_old").isNull(), ADDED)
             .when(F.col("in_new").isNull(), REMOVED)
             .when(same, UNCHANGED)
             .when(F.col("h").isNull() | F.col("o_hash").isNull(), UNCONFIRMED)
             .when(F.col("h") == F.col("o_hash"), TOUCHED)
             .otherwise(CHANGED))
    joined = o.join(n, "path", "full_outer").withColumn("state", state)
    fresh = F.col("state").isin(ADDED, UNCONFIRMED, TOUCHED, CHANGED) & F.col("h").isNotNull()
    carried = F.when(F.col("state") != REMOVED,
                     F.when(fresh, F.col("h")).otherwise(F.col("o_hash")))
    source = F.when(carried.isNotNull(),
                    F.when(fresh, F.lit(COMPARED)).otherwise(F.col("o_source")))
    return joined.select("path", "state", carried.alias("content_hash"),
                         source.alias("hash_source"))


def tally(journal: DataFrame) -> DataFrame:
    return journal.groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def tally_row(journal: DataFrame) -> DataFrame:
    """All six states in one row, zeros included."""
    return journal.agg(*[F.count_if(F.col("state") == s).alias(s)
                         for s in JOURNAL_STATES])


def cold_rows(files: DataFrame, in_scope: Column) -> DataFrame:
    """In-scope files without a hash."""
    return files.filter(F.col("content_hash").isNull() & (F.col("kind") == FILE) & in_scope)


def cold_report(files: DataFrame, in_scope: Column) -> DataFrame:
    return cold_rows(files, in_scope).agg(
        F.count(F.lit(1)).alias("files"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def refuse_over(cold: DataFrame, max_files: int) -> None:
    """The ceiling is stated before the work."""
    if cold.limit(max_files + 1).count() > max_files:
        raise Refused("more than %d cold files; raise the limit or narrow the scope"
                      % max_files)


def backfill(files: DataFrame, in_scope: Column, hashes: DataFrame) -> DataFrame:
    """`files` with cold in-scope hashes filled from `hashes(path, digest)`.

    Unreadable files have no digest and stay cold.  The journal is untouched.
    """
    cold = F.col("content_hash").isNull() & (F.col("kind") == FILE) & in_scope
    filled = files.join(hashes.select("path", "digest"), "path", "left")
    use = cold & F.col("digest").isNotNull()
    return filled.select(
        *[c for c in files.columns if c not in ("content_hash", "hash_source")],
        F.when(use, F.col("digest")).otherwise(F.col("content_hash")).alias("content_hash"),
        F.when(use, F.lit(BACKFILLED)).otherwise(F.col("hash_source")).alias("hash_source"))


def backfill_report(files: DataFrame, in_scope: Column, hashes: DataFrame) -> DataFrame:
    cold = cold_rows(files, in_scope).join(
        hashes.select("path", "digest"), "path", "left")
    return cold.agg(F.count(F.lit(1)).alias("files"),
                    F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"),
                    F.count("digest").alias("hashed"),
                    F.count_if(F.col("digest").isNull()).alias("unreadable"))


def hash_coverage(files: DataFrame, in_scope: Column) -> DataFrame:
    """How much of the scope is hashed, split by how the hash was obtained."""
    if "hash_source" not in files.columns:
        return files.limit(0).agg(
            *[F.lit(0).cast("bigint").alias(c)
              for c in ("in_scope", "hashed", "compared", "backfilled")],
            F.lit(0.0).alias("percent"), F.lit(False).alias("migrated"))
    ours = files.filter((F.col("kind") == FILE) & in_scope)
    has = F.col("content_hash").isNotNull()
    back = has & (F.coalesce("hash_source", F.lit("")) == BACKFILLED)
    return ours.agg(
        F.count(F.lit(1)).alias("in_scope"), F.count_if(has).alias("hashed"),
        F.count_if(has & ~back).alias("compared"), F.count_if(back).alias("backfilled"),
        F.coalesce(F.try_divide(F.count_if(has) * 100.0, F.count(F.lit(1))),
                   F.lit(0.0)).alias("percent"), F.lit(True).alias("migrated"))
