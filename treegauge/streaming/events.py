"""Event predicates and attribution, usable on batch and streaming frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import paths as P
from ..joins import lookup
from ..schemas import ADDED, EVENTS, REMOVED, UNCHANGED

# Bits of an event mask.
MASKS = {
    "modify": 0x00000002, "close_write": 0x00000008, "moved_from": 0x00000040,
    "moved_to": 0x00000080, "create": 0x00000100, "delete": 0x00000200,
    "delete_self": 0x00000400, "move_self": 0x00000800, "overflow": 0x00004000,
    "ignored": 0x00008000, "isdir": 0x40000000,
}
SELF_BITS = MASKS["delete_self"] | MASKS["move_self"] | MASKS["ignored"]


def event_stream(spark: SparkSession, folder: str, per_trigger: int | None = None) -> DataFrame:
    """Events written as parquet files to a folder, as a stream."""
    reader = spark.readStream.schema(EVENTS)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(folder)


def silent_stream(spark: SparkSession) -> DataFrame:
    """A source that never has anything, for places without events."""
    return (spark.readStream.format("rate").option("rowsPerSecond", 1).load()
            .filter(F.lit(False))
            .select(F.col("timestamp").alias("ts"), F.lit("").alias("path"),
                    F.lit(0).alias("mask")))


def journal_events(journal: DataFrame, at: Column) -> DataFrame:
    """What a sweep found, as events `ts, path, mask` for the same consumers.

    This is how a place without a watcher, or one that lost events, catches up.
    """
    bit = (F.when(F.col("state") == ADDED, MASKS["create"])
           .when(F.col("state") == REMOVED, MASKS["delete"])
           .otherwise(MASKS["close_write"]))
    return (journal.filter(F.col("state") != UNCHANGED)
            .select(at.alias("ts"), "path", bit.cast("int").alias("mask")))


def named_bits(mask) -> Column:
    mask = F.col(mask) if isinstance(mask, str) else mask
    return F.array_compact(F.array(*[
        F.when(mask.bitwiseAND(F.lit(bit)) != 0, F.lit(name))
        for name, bit in MASKS.items()]))


def is_own_end(mask) -> Column:
    """A watch losing its own directory, or an overflow: nobody's change."""
    mask = F.col(mask) if isinstance(mask, str) else mask
    return mask.bitwiseAND(F.lit(SELF_BITS | MASKS["overflow"])) != 0


def is_store_write(path, stores: list[str]) -> Column:
    """The store's own files, their siblings, and the folders that hold them."""
    path = F.col(path) if isinstance(path, str) else path
    hit = F.lit(False)
    for store in stores:
        hit = (hit | (path == store) | F.startswith(path, F.lit(store + "-"))
               | F.startswith(path, F.lit(store + "."))
               | P.under(path, store.rsplit("/", 1)[0]))
    return hit


def is_layout(path) -> Column:
    """Changes which files belong, whatever the scope says of the file itself."""
    path = F.col(path) if isinstance(path, str) else path
    return P.basename(F.rtrim(path, F.lit("/"))).isin(".gitignore", ".git")


def keep(path, stores: list[str], in_scope: Column) -> Column:
    """Store writes never, layout changes always, anything else by scope."""
    return (F.when(is_store_write(path, stores), F.lit(False))
            .when(is_layout(path), F.lit(True))
            .otherwise(F.coalesce(in_scope, F.lit(False))))


def with_kept(events: DataFrame, stores: DataFrame, in_scope: Column) -> DataFrame:
    """`events` plus boolean `kept`: the rule of `keep` for a table of stores (path) of any length.

    A store's own files, their siblings and its folder all lie in or are that
    folder, so the guard is an equality join on the folders above an event,
    fanned out once per distinct directory.  A store lies below the root.
    """
    folders = stores.select(P.dirname("path").alias("folder")).distinct()
    dirs = events.select(P.dirname("path").alias("dir")).distinct()
    guarded = (dirs.select("dir", F.explode(P.self_and_ancestors("dir")).alias("folder"))
               .join(folders, "folder").select("dir", F.lit(True).alias("in_store")).distinct())
    own = folders.select(F.col("folder").alias("path"), F.lit(True).alias("is_store"))
    return (lookup(events.withColumn("dir", P.dirname("path")).withColumn("wanted", in_scope), guarded, ["dir"])
            .join(own, "path", "left")
            .select(*events.columns,
                    F.when(F.coalesce("in_store", "is_store", F.lit(False)), F.lit(False))
                    .when(is_layout("path"), F.lit(True))
                    .otherwise(F.coalesce("wanted", F.lit(False))).alias("kept")))


def owner(path, roots: dict[str, str]) -> Column:
    """Project of the longest root over `path` (roots: path -> project).

    The first covering root decides alone, even if its scope then says no.
    Stateless, so it suits streams.  The expression grows with the registry;
    `attribute` joins a table of any length.
    """
    chosen = F.lit(None).cast("string")
    for root in sorted(roots, key=len):
        chosen = F.when(P.under(path, root), F.lit(roots[root])).otherwise(chosen)
    return chosen


def attribute(events: DataFrame, projects: DataFrame) -> DataFrame:
    """`events` plus `project_id` of the innermost project, NULL for none.

    Decided per distinct directory and joined back; an event on a root itself
    belongs to that root.
    """
    roots = projects.select("project_id", F.col("path").alias("root"))
    dirs = events.select(P.dirname("path").alias("dir")).distinct()
    above = (dirs.select("dir", F.explode(P.self_and_ancestors("dir")).alias("root"))
             .join(roots, "root").groupBy("dir")
             .agg(F.max_by("project_id", F.length("root")).alias("above")))
    own = roots.select(F.col("root").alias("path"), F.col("project_id").alias("own"))
    return (lookup(events.withColumn("dir", P.dirname("path")), above, ["dir"])
            .join(own, "path", "left")
            .select(*events.columns, F.coalesce("own", "above").alias("project_id")))
