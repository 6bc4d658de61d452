"""The periodic sweep as a stream: a source whose offsets are passes over the catalogue.

The source says when a pass is due.  A batch makes the pass, compares it with
the last one that was acted on, and updates the projects that moved.  However
many passes were missed while nothing ran, the next batch compares with the
state before the stop, so every change made meanwhile is found; a batch that
was ended halfway finds its own pass again and acts on the same changes.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from .. import Refused
from ..operators import journal as jo
from .service import sweep_hits

#: Fixed value: seconds between two passes.
EVERY = 30 * 60


class SweepClock(DataSource):
    """`sweepclock`: one row (pass, due in seconds) for the latest pass that is due.

    Options: `every`, the seconds between passes, and `from`, when the count
    begins.  Offsets are numbers of passes, so a restarted query goes on where
    it stopped; passes that were missed are one row, the last of them, for one
    comparison finds what all of them would have found.
    """

    @classmethod
    def name(cls) -> str:
        return "sweepclock"

    def schema(self) -> str:
        return "pass bigint, due bigint"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Clock(float(self.options.get("every", EVERY)), float(self.options.get("from", 0)))


class _Clock(SimpleDataSourceStreamReader):
    def __init__(self, every: float, begin: float):
        self.every, self.begin = every, begin

    def _due(self) -> int:
        return int((time.time() - self.begin) // self.every)

    def initialOffset(self) -> dict:
        # The pass that is due at the first start is made at once.
        return {"pass": self._due() - 1}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        end = {"pass": max(start["pass"], self._due())}
        return self.readBetweenOffsets(start, end), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        due = [(end["pass"], int(self.begin + end["pass"] * self.every))]
        return iter(due if end["pass"] > start["pass"] else [])


def sweeps(spark: SparkSession, every: float = EVERY, begin: float = 0) -> DataFrame:
    spark.dataSource.register(SweepClock)
    return spark.readStream.format("sweepclock").option("every", str(every)).option("from", str(begin)).load()


class Sweeper:
    """Acts on passes: scan, compare, hits, updates; its passes lie in `folder`, one per batch.

    `scan()` gives the catalogue as it is (path, kind, size, mtime_ns,
    in_scope, hash_now), `projects()` the registry and `kept` what of
    attributed paths is worth an update: all are asked for each batch, so scope
    and registry are those of the moment.
    """

    def __init__(self, folder: str, scan: Callable[[], DataFrame], projects: Callable[[], DataFrame],
                 kept: Callable[[DataFrame], DataFrame], update: Callable[[str], None],
                 report: Callable[[str], None] = lambda project: None):
        self.folder, self.scan, self.projects = folder.rstrip("/"), scan, projects
        self.kept, self.update, self.report = kept, update, report

    def _pass(self, spark: SparkSession, batch: int) -> DataFrame | None:
        """A pass that was written whole: files appear when all are there."""
        try:
            return spark.read.parquet("%s/%d" % (self.folder, batch))
        except AnalysisException as absent:
            if absent.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return None

    def journal(self, spark: SparkSession, batch: int) -> DataFrame:
        """What moved between the pass of the batch before and this one; the first finds all added.

        Hashes go from pass to pass: what did not move keeps its hash.
        """
        new, old = self._pass(spark, batch), self._pass(spark, batch - 1)
        if old is None:
            old = new.limit(0)
        return jo.compare(old, new)

    def act(self, ticks: DataFrame, batch: int) -> None:
        if ticks.isEmpty():
            return
        spark = ticks.sparkSession
        if self._pass(spark, batch) is None:
            seen = self.scan()
            before = self._pass(spark, batch - 1)
            if before is None:
                before = seen.limit(0).selectExpr("path", "size", "mtime_ns", "cast(null as string) as content_hash",
                                                  "cast(null as string) as hash_source")
            hashes = jo.compare(before, seen).select("path", "content_hash", "hash_source")
            seen.join(hashes, "path").write.mode("overwrite").parquet("%s/%d" % (self.folder, batch))
        hits = sweep_hits(self.journal(spark, batch), self.projects(), self.kept)
        for row in hits.orderBy("project_id").toLocalIterator():
            if not row["watched"]:
                self.report(row["project_id"])
                continue
            try:
                self.update(row["project_id"])
            except Refused as problem:
                print("REFUSED %s: %s" % (row["project_id"], problem))

    def start(self, ticks: DataFrame, checkpoint: str, forever: bool = True):
        """Runs until stopped, or once over what is due."""
        writer = ticks.writeStream.foreachBatch(self.act).option("checkpointLocation", checkpoint)
        return writer.start() if forever else writer.trigger(availableNow=True).start()
