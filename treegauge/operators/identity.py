"""Is this the same tree?  Fingerprints, moves, copies, deletions.

A fingerprint is the set of (relative path, size) lines under a directory.
Lines are hashed one by one and combined with exclusive or, which needs no
order: partial results merge, so no task ever holds a whole tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import paths as P
from ..joins import lookup
from ..schemas import DIR, FILE

PRESENT, MOVE, COPY, DELETED, AMBIGUOUS = (
    "present", "move", "copy", "deleted", "ambiguous")

# Two 60-bit slices of each line's hash: 120 bits tell trees apart.
_SLICES = ((1, 15), (16, 15))


def _combined(line: Column) -> list[Column]:
    digest = F.sha2(line, 256)
    return [F.bit_xor(F.conv(F.substring(digest, at, n), 16, 10).cast("bigint"))
            .alias("x%d" % i) for i, (at, n) in enumerate(_SLICES)]


def _sealed(rows: DataFrame, *keys: str) -> DataFrame:
    parts = [F.col("files").cast("string")] + [
        F.col("x%d" % i).cast("string") for i in range(len(_SLICES))]
    return rows.select(*keys, "files", "bytes",
                       F.sha2(F.concat_ws(":", *parts), 256).alias("fingerprint"))


def _lines(rel: Column) -> Column:
    return F.concat(rel, F.lit("\0"), F.col("size").cast("string"))


def project_fingerprints(content: DataFrame) -> DataFrame:
    """`project_id, files, bytes, fingerprint` of `content(project_id, root, path, size)`.

    A project without rows has no fingerprint and no row.
    """
    rel = P.relative("path", F.col("root"))
    return _sealed(content.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"),
        *_combined(_lines(rel))), "project_id")


def tree_fingerprints(files: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """`dir, files, bytes, fingerprint` for every directory holding files.

    `only(dir)` limits the hashing to candidate directories.
    """
    spread = (files.filter(F.col("kind") == FILE)
              .select("path", "size", F.explode(P.ancestors("path")).alias("dir")))
    if only is not None:
        # The top folders are over every file, so their rows are split over tasks.
        spread = lookup(spread, only.select("dir").distinct(), ["dir"], "inner")
    rel = P.relative("path", F.col("dir"))
    return _sealed(spread.groupBy("dir").agg(
        F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"),
        *_combined(_lines(rel))), "dir")


def same_trees(prints: DataFrame) -> DataFrame:
    """Directories that share their tree with another: `fingerprint, dirs, first_dir`."""
    return (prints.groupBy("fingerprint").agg(
        F.count(F.lit(1)).alias("dirs"), F.min("dir").alias("first_dir"),
        F.min("files").alias("files")).filter(F.col("dirs") > 1))


def verdict(old_here: Column, new_here: Column) -> Column:
    return (F.when(old_here & new_here, F.lit(COPY)).when(new_here, F.lit(MOVE))
            .when(old_here, F.lit(PRESENT)).otherwise(F.lit(DELETED)))


def _matching(projects: DataFrame, content: DataFrame, files: DataFrame) -> DataFrame:
    """Per missing project: how many directories hold its tree, and the first.

    Every directory is fingerprinted where its files are listed, and what is
    shuffled is one combined row per task and directory: no folder over all
    files comes to one task.  Trees with many copies are counted per
    fingerprint before they meet a project, so no pair of project and copy is
    ever made.
    """
    mine = project_fingerprints(content)
    dirs = files.filter(F.col("kind") == DIR).select(
        F.col("path").alias("dir"), "dev", "inode")
    prints = tree_fingerprints(files).select("dir", "fingerprint").join(dirs, "dir")
    by_print = prints.groupBy("fingerprint").agg(
        F.count(F.lit(1)).alias("n_print"), F.min("dir").alias("print_dir"))
    by_inode = prints.groupBy("fingerprint", "dev", "inode").agg(
        F.count(F.lit(1)).alias("n_inode"), F.min("dir").alias("inode_dir"))
    gone = (projects.select("project_id", "path", F.col("root_dev").alias("dev"),
                            F.col("root_inode").alias("inode"))
            .join(dirs.select(F.col("dir").alias("path")), "path", "left_anti")
            .join(mine.select("project_id", "fingerprint"), "project_id"))
    found = lookup(gone, by_print, ["fingerprint"])
    found = lookup(found, by_inode, ["fingerprint", "dev", "inode"])
    return found.select("project_id", "n_print", "print_dir", "n_inode", "inode_dir")


def recognise(projects: DataFrame, content: DataFrame, files: DataFrame) -> DataFrame:
    """`project_id, verdict, path, candidates, by` for every project.

    Directories with the recorded (dev, inode) come first, confirmed by
    fingerprint; otherwise any directory with the fingerprint.  Two or more
    of them are ambiguous and none is chosen.
    """
    here = files.filter(F.col("kind") == DIR).select("path", F.lit(True).alias("here"))
    rows = (projects.join(here, "path", "left")
            .join(_matching(projects, content, files), "project_id", "left"))
    present = F.col("here").isNotNull()
    inode = F.coalesce(F.col("n_inode") > 0, F.lit(False))
    n = F.when(inode, F.col("n_inode")).otherwise(F.coalesce("n_print", F.lit(0)))
    return rows.select(
        "project_id",
        F.when(present, PRESENT).when(n > 1, AMBIGUOUS).when(n == 1, MOVE)
        .otherwise(DELETED).alias("verdict"),
        F.when(present, F.col("path")).when(n == 1, F.when(inode, F.col("inode_dir"))
                                            .otherwise(F.col("print_dir"))).alias("path"),
        F.when(present, F.lit(1)).otherwise(n).cast("bigint").alias("candidates"),
        F.when(~present & (n > 0), F.when(inode, F.lit("inode"))
               .otherwise(F.lit("fingerprint"))).alias("by"))


def candidates(project_print: str, prints: DataFrame) -> DataFrame:
    """The directories with one project's fingerprint, for a user to choose."""
    return prints.filter(F.col("fingerprint") == project_print).select("dir").orderBy("dir")
