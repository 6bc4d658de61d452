"""The two clocks: a periodic sweep, and bursts of events with a quiet end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F, Window

from .. import Refused
from ..schemas import UNCHANGED

# How often the whole catalogue is compared, how long it must
# be quiet before a burst is acted on.
SWEEP = "30 minutes"
DEBOUNCE = "2 seconds"


def sweep_windows(events: DataFrame, every: str = SWEEP) -> DataFrame:
    """Events per sweep interval, and how many projects they are about.

    Counted per interval and project first, so a busy interval is merged before
    the shuffle and its projects are counted exactly.
    """
    return (events.groupBy(F.window("ts", every).alias("w"), "project_id")
            .agg(F.count(F.lit(1)).alias("n")).groupBy("w")
            .agg(F.sum("n").alias("events"), F.count("project_id").alias("about_projects"))
            .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"),
                    "events", "about_projects"))


def stream_bursts(events: DataFrame, gap: str = DEBOUNCE,
                  lateness: str = "10 minutes") -> DataFrame:
    """Bursts of a stream `ts, project_id`: the quiet period is global.

    A key that is true for every event makes the session global (a literal
    would be optimized away, and streams refuse keyless sessions).  Sessions
    of one input partition are merged before the shuffle (session setting), so
    the one key receives sessions and not events.
    """
    return (events.withWatermark("ts", lateness)
            .groupBy(F.session_window("ts", gap).alias("w"),
                     F.col("ts").isNotNull().alias("all"))
            .agg(F.count(F.lit(1)).alias("events"),
                 F.array_sort(F.collect_set("project_id")).alias("projects"))
            .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"),
                    "events", "projects"))


def bursts(events: DataFrame, gap_seconds: float, grain: str = "day",
           ) -> tuple[DataFrame, DataFrame]:
    """The same bursts over stored events, without one task holding them all.

    Returns `burst, last_ts, events` (a burst is named by its first event) and
    `burst, project_id`.  Events are combined per gap-wide slot, slots are
    joined into runs inside each `grain`, and only one row per grain is
    ordered globally to stitch runs that cross its borders.
    """
    gap = F.lit(int(gap_seconds * 1_000_000))
    micros = F.unix_micros("ts")
    slotted = events.select(micros.alias("us"), F.floor(micros / gap).alias("slot"),
                            "project_id", F.date_trunc(grain, "ts").alias("grain"))
    # All events of one slot are within one gap of each other.
    slots = slotted.groupBy("grain", "slot").agg(
        F.min("us").alias("first"), F.max("us").alias("last"),
        F.count(F.lit(1)).alias("n"))
    inside = Window.partitionBy("grain").orderBy("slot")
    starts = F.when(F.coalesce(F.col("first") - F.lag("last").over(inside) <= gap,
                               F.lit(False)), F.lit(None)).otherwise(F.col("first"))
    slots = slots.withColumn("starts", starts).withColumn(
        "run", F.last("starts", ignorenulls=True).over(
            inside.rowsBetween(Window.unboundedPreceding, 0)))
    edges = slots.groupBy("grain").agg(
        F.min("first").alias("g_first"), F.max("last").alias("g_last"),
        F.min("run").alias("first_run"), F.max("run").alias("last_run"))
    by_grain = Window.orderBy("grain")
    linked = F.coalesce(F.col("g_first") - F.lag("g_last").over(by_grain) <= gap, F.lit(False))
    chain = F.when((F.col("first_run") != F.col("last_run")) | ~F.col("linked"),
                   F.col("last_run"))
    edges = (edges.withColumn("linked", linked).withColumn("chain", chain)
             .withColumn("carried", F.last("chain", ignorenulls=True).over(
                 by_grain.rowsBetween(Window.unboundedPreceding, -1))))
    named = slots.join(edges, "grain").select(
        "grain", "slot", "last", "n",
        F.when((F.col("run") == F.col("first_run")) & F.col("linked"), F.col("carried"))
        .otherwise(F.col("run")).alias("burst_us"))
    burst = F.timestamp_micros("burst_us").alias("burst")
    totals = (named.groupBy("burst_us").agg(F.max("last").alias("l"), F.sum("n").alias("events"))
              .select(burst, F.timestamp_micros("l").alias("last_ts"), "events"))
    hits = (slotted.select("grain", "slot", "project_id").distinct()
            .join(named.select("grain", "slot", "burst_us"), ["grain", "slot"])
            .select(burst, "project_id").distinct())
    return totals, hits


def sweep_hits(journal: DataFrame, projects: DataFrame, kept: Callable[[DataFrame], DataFrame],
               ) -> DataFrame:
    """`project_id, watched`: projects the sweep's own findings call for.

    `kept` drops attributed paths that are not worth an update.  Watched
    projects are updated, the others only reported.
    """
    from .events import attribute

    moved = journal.filter(F.col("state") != UNCHANGED).select("path")
    hit = kept(attribute(moved, projects)).select("project_id").distinct()
    return hit.join(projects.select("project_id", F.col("watch").alias("watched")), "project_id")


def serve(events: DataFrame, kept: Callable[[DataFrame], DataFrame],
          update: Callable[[str], None], checkpoint: str,
          every: str | None = None):
    """Update every project a micro-batch has kept events for.

    `kept` is called per batch, so scope is read again from the tree each
    time.  Only project ids reach the driver.  A refused update is reported
    and the run goes on for the other projects; any other failure fails the
    batch, which is then replayed from the checkpoint.
    """
    def act(batch: DataFrame, _batch_id: int) -> None:
        hit = kept(batch).select("project_id").filter(
            F.col("project_id").isNotNull()).distinct()
        for row in hit.orderBy("project_id").toLocalIterator():
            try:
                update(row["project_id"])
            except Refused as problem:
                print("REFUSED %s: %s" % (row["project_id"], problem))

    writer = events.writeStream.foreachBatch(act).option("checkpointLocation", checkpoint)
    if every:
        return writer.trigger(processingTime=every).start()
    return writer.trigger(availableNow=True).start()


def fragmentation(file_sizes: DataFrame, small: int = 32 << 20) -> DataFrame:
    """Share of a layer's files that are smaller than `small` bytes."""
    n: Column = F.count(F.lit(1))
    return file_sizes.agg(F.coalesce(
        F.try_divide(F.count_if(F.col("length") < small), n), F.lit(0.0)).alias("ratio"))
