"""Which folders are watched, kept as state of a stream of events.

Per project there is a map of folders, in the state store and not in a row, so
it may be as large as the project.  A folder that is made or moved in is
watched; one that is deleted is not any more, with all below it.  A folder that
is moved away may come back: it stays watched until no event can be as old as
the end of its grace period, which a timer tells.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .events import MASKS

#: Where a session must keep such state; set it before the query starts.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass",
               "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: How long a folder that was moved away may be missing, and how late events may be.
GRACE_MS, LATE = 2_000, "10 seconds"

CHANGES = "project_id string, folder string, watched boolean, at_ms bigint"


class WatchSet(StatefulProcessor):
    """Folders of one project: path to the time it was first seen, and those that are leaving."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.folders = handle.getMapState("folders", "folder string", "since_ms bigint")
        self.leaving = handle.getMapState("leaving", "folder string", "until_ms bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        for row in sorted(rows, key=lambda r: (r["ms"], r["path"])):
            at = (row["path"],)
            if row["mask"] & (MASKS["create"] | MASKS["moved_to"]):
                if self.leaving.containsKey(at):
                    self.leaving.removeKey(at)
                if not self.folders.containsKey(at):
                    self.folders.updateValue(at, (row["ms"],))
                    yield Row(project_id=key[0], folder=row["path"], watched=True, at_ms=row["ms"])
            elif row["mask"] & (MASKS["delete"] | MASKS["delete_self"]):
                yield from self._drop(key, row["path"], row["ms"])
            elif row["mask"] & (MASKS["moved_from"] | MASKS["move_self"]) and self.folders.containsKey(at):
                until = row["ms"] + GRACE_MS
                self.leaving.updateValue(at, (until,))
                self.handle.registerTimer(until)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        gone = [(f[0], until[0]) for f, until in self.leaving.iterator() if until[0] <= now]
        for folder, until in sorted(gone):
            self.leaving.removeKey((folder,))
            yield from self._drop(key, folder, until)

    def _drop(self, key, top: str, ms: int) -> Iterator[Row]:
        below = top.rstrip("/") + "/"
        # Collected first: the map must not change while it is read.
        own = [f[0] for f in self.folders.keys() if f[0] == top or f[0].startswith(below)]
        for folder in sorted(own):
            self.folders.removeKey((folder,))
            if self.leaving.containsKey((folder,)):
                self.leaving.removeKey((folder,))
            yield Row(project_id=key[0], folder=folder, watched=False, at_ms=ms)


def watch_changes(events: DataFrame) -> DataFrame:
    """`project_id, folder, watched, at_ms` from attributed events `ts, path, mask, project_id`.

    Events of files and of no project pass by.  The session needs STATE_STORE.
    """
    folders = (events.withWatermark("ts", LATE)
               .filter((F.col("mask").bitwiseAND(F.lit(MASKS["isdir"])) != 0) & F.col("project_id").isNotNull())
               .select("project_id", "ts", "path", "mask", F.unix_millis("ts").alias("ms")))
    return folders.groupBy("project_id").transformWithState(
        statefulProcessor=WatchSet(), outputStructType=CHANGES, outputMode="Append", timeMode="EventTime")
