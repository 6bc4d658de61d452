"""The folder tree of a project: nodes, edges, and what drawing it needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

from ..functions import paths as P
from ..functions.vectors import mulberry32
from ..joins import lookup
from ..session import cut_lineage

# A folder with more direct files than this gets one bucket per
# type, and the separator no file name can contain.
FANOUT = 4
SEP = "\0"


def _files(rows: DataFrame, root: str) -> DataFrame:
    state = F.col("state") if "state" in rows.columns else F.lit("fresh")
    rel = P.relative("path", root)
    return rows.select(rel.alias("id"), P.dirname(rel).alias("folder"),
                       P.basename("path").alias("name"), P.type_of("path").alias("type"),
                       F.coalesce(state, F.lit("fresh")).alias("state"),
                       F.size(F.split(rel, "/", -1)).alias("level"))


def _groups(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files per folder and type, and the folders with too many.

    Everything but the leaves is derived from these counts, so a folder with a
    third of all files is a row per type here.
    """
    groups = files.groupBy("folder", "type").agg(F.count(F.lit(1)).alias("n"))
    crowded = (groups.groupBy("folder").agg(F.sum("n").alias("n"))
               .filter(F.col("n") > FANOUT).select("folder", F.lit(True).alias("crowded")))
    return groups, crowded


def _bucket() -> Column:
    return F.concat("folder", F.lit(SEP), F.col("type"))


def _leaves(files: DataFrame, crowded: DataFrame) -> DataFrame:
    return lookup(files, crowded, ["folder"]).withColumn(
        "bucket", F.when(F.col("crowded"), _bucket()))


def _buckets(groups: DataFrame, crowded: DataFrame) -> DataFrame:
    return groups.join(crowded, "folder", "left_semi").select("folder", "type", _bucket().alias("bucket"))


def _folders(groups: DataFrame) -> DataFrame:
    return (groups.select("folder").distinct()
            .select(F.explode(F.concat(P.relative_ancestors("folder"), F.array("folder")))
                    .alias("id")).distinct().filter(F.col("id") != ""))


def nodes(rows: DataFrame, root: str) -> DataFrame:
    """`id, kind, name, path, depth, type, state` of `rows(path[, state])`.

    The root is the empty id.  A file moved into a bucket is one deeper.
    """
    files = _files(rows, root)
    groups, crowded = _groups(files)
    none = F.lit(None).cast("string")

    def depth(of: str) -> Column:
        return F.when(F.col(of) == "", F.lit(0)).otherwise(F.size(F.split(of, "/", -1)))

    folders = (_folders(groups).unionByName(
        files.sparkSession.createDataFrame([("",)], "id string"))
        .select("id", F.lit("dir").alias("kind"),
                F.when(F.col("id") == "", F.lit(".")).otherwise(P.basename("id")).alias("name"),
                F.col("id").alias("path"), depth("id").alias("depth"),
                none.alias("type"), none.alias("state")))
    buckets = _buckets(groups, crowded).select(
        F.col("bucket").alias("id"), F.lit("bucket").alias("kind"), F.col("type").alias("name"),
        F.col("bucket").alias("path"), (depth("folder") + 1).alias("depth"),
        none.alias("type"), none.alias("state"))
    leaves = _leaves(files, crowded).select(
        "id", F.lit("file").alias("kind"), "name", F.col("id").alias("path"),
        (F.col("level") + F.col("bucket").isNotNull().cast("int")).alias("depth"),
        "type", "state")
    return folders.unionByName(buckets).unionByName(leaves)


def edges(rows: DataFrame, root: str) -> DataFrame:
    """`from, to`: folder or bucket to child; a bucket takes over its files."""
    files = _files(rows, root)
    groups, crowded = _groups(files)
    below = _folders(groups).select(P.dirname("id").alias("from"), F.col("id").alias("to"))
    buckets = _buckets(groups, crowded).select(F.col("folder").alias("from"),
                                               F.col("bucket").alias("to"))
    leaves = _leaves(files, crowded).select(F.coalesce("bucket", "folder").alias("from"),
                                            F.col("id").alias("to"))
    return below.unionByName(buckets).unionByName(leaves)


def tally(all_nodes: DataFrame) -> DataFrame:
    """`kind, state, n`; states are those of files."""
    return all_nodes.groupBy("kind", "state").agg(F.count(F.lit(1)).alias("n"))


def link_weights(all_edges: DataFrame) -> DataFrame:
    """`from, to, weight`: one over the sum of both ends' degrees.

    A crowded folder or bucket is one hot end; its degree is one row.
    """
    ends = all_edges.select(F.explode(F.array("from", "to")).alias("id"))
    degree = ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    ends = all_edges
    for end, name in (("from", "d1"), ("to", "d2")):
        ends = lookup(ends, degree.select(F.col("id").alias(end), F.col("degree").alias(name)),
                      [end], "inner")
    return (ends.select("from", "to",
                    (F.lit(1.0) / (F.col("d1") + F.col("d2"))).alias("weight")))


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """`df` plus `index`, its 0-based place in the total order.

    Range partitions are written once (so their borders are fixed), counted,
    and numbered inside; only one count per partition is summed up.
    """
    placed = cut_lineage(df.repartitionByRange(*order).withColumn(
        "part", F.spark_partition_id()))
    counts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select("part", (F.coalesce(F.sum("n").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0))).alias("start"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return (placed.withColumn("inside", inside).join(starts, "part")
            .withColumn("index", F.col("start") + F.col("inside") - 1)
            .drop("part", "inside", "start"))


def seed_positions(rows: DataFrame, root: str, seed: int = 1337) -> DataFrame:
    """`id, x, y`: the first placement, every node near its parent.

    A node's offset depends on its place in id order; its position is the sum
    of the offsets from the root down to it, so parents need no second pass.
    """
    placed = numbered(nodes(rows, root).select("id", "kind"), "id")
    def offset(call):
        return (mulberry32(call, seed) - 0.5) * 2.0
    offsets = placed.select("id", offset(F.col("index") * 2 + 1).alias("dx"),
                            offset(F.col("index") * 2 + 2).alias("dy"))
    parents = edges(rows, root).select(F.col("to").alias("id"), F.col("from").alias("parent"))
    placed = placed.join(parents, "id", "left")
    # Folders and buckets first: their chain follows from id and parent (a
    # bucket's id holds its folder before the separator).
    none = F.array().cast("array<string>")
    inner = placed.filter(F.col("kind") != "file").select("id", F.explode(F.array_distinct(
        F.concat(F.array(F.lit("")), P.relative_ancestors("id"),
                 F.when(F.col("parent").isNotNull(), F.array("parent")).otherwise(none),
                 F.array("id")))).alias("link"))
    inner = (inner.join(offsets.withColumnRenamed("id", "link"), "link")
             .groupBy("id").agg(F.sum("dx").alias("x"), F.sum("dy").alias("y")))
    leaves = placed.filter(F.col("kind") == "file").join(offsets, "id")
    leaves = (lookup(leaves, inner.withColumnRenamed("id", "parent"), ["parent"], "inner")
              .select("id", (F.col("x") + F.col("dx")).alias("x"),
                      (F.col("y") + F.col("dy")).alias("y")))
    return inner.unionByName(leaves)


def extent(positions: DataFrame) -> DataFrame:
    return positions.agg(F.min("x").alias("min_x"), F.max("x").alias("max_x"),
                         F.min("y").alias("min_y"), F.max("y").alias("max_y"))


def nearest(positions: DataFrame, x: float, y: float, within: float = 18.0) -> DataFrame:
    """The node closest to a point, if one is nearer than `within`."""
    distance = F.hypot(F.col("x") - F.lit(x), F.col("y") - F.lit(y))
    return (positions.select("id", distance.alias("distance"))
            .filter(F.col("distance") < within)
            .agg(F.min_by("id", F.struct("distance", "id")).alias("id"),
                 F.min("distance").alias("distance")))
