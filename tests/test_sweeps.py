"""The sweep as a stream, and watched folders as its state: both over restarts."""

import time
from datetime import datetime, timedelta

import pytest

from treegauge.streaming import sweeps as sw, watched as wt
from treegauge.streaming.events import MASKS

CATALOGUE = "path string, kind string, size bigint, mtime_ns bigint, in_scope boolean, hash_now string"


class Tree:
    """A tree that tests change, and the calls a sweeper made."""

    def __init__(self, spark, folder):
        self.spark, self.folder = spark, folder
        self.files = {"/w/a/x": 1, "/w/a/y": 1, "/w/b/x": 1, "/w/c/x": 1}
        self.updated, self.reported, self.failing = [], [], False

    def scan(self):
        return self.spark.createDataFrame(
            [(p, "file", v, v * 10, True, "h%d" % v) for p, v in self.files.items()], CATALOGUE)

    def projects(self):
        return self.spark.createDataFrame([("a", "/w/a", True), ("b", "/w/b", True), ("c", "/w/c", False)],
                                          "project_id string, path string, watch boolean")

    def update(self, project):
        self.updated.append(project)
        if self.failing:
            raise ValueError("killed")

    def run(self, every=0.2):
        """What is due, then stop."""
        sweeper = sw.Sweeper(self.folder + "/passes", self.scan, self.projects, lambda hits: hits, self.update,
                             self.reported.append)
        query = sweeper.start(sw.sweeps(self.spark, every), self.folder + "/ck", forever=False)
        query.awaitTermination(120)
        done = self.updated, self.reported
        self.updated, self.reported = [], []
        time.sleep(2 * every)
        return done


def test_a_sweep_finds_what_changed_while_it_was_down(spark, tmp_path):
    tree = Tree(spark, str(tmp_path))
    assert tree.run() == (["a", "b"], ["c"])
    assert tree.run() == ([], [])
    tree.files["/w/b/x"] = 2
    tree.files["/w/c/new"] = 1
    assert tree.run() == (["b"], ["c"])
    del tree.files["/w/a/y"]
    assert tree.run() == (["a"], [])
    assert tree.run() == ([], [])


def test_a_killed_batch_is_replayed_with_the_same_hits(spark, tmp_path):
    tree = Tree(spark, str(tmp_path))
    tree.run()
    tree.files["/w/a/x"] = 2
    tree.files["/w/b/x"] = 2
    tree.failing = True
    with pytest.raises(Exception, match="killed"):
        tree.run()
    assert tree.updated == ["a"]
    tree.updated, tree.failing = [], False
    # What changes between the two runs belongs to the next pass, not to the replayed one.
    tree.files["/w/c/x"] = 5
    first = tree.run()
    later = tree.run()
    assert first[0][:2] == ["a", "b"]
    assert first[1] + later[1] == ["c"] and later[0] == []


def test_missed_passes_are_one_row():
    clock = sw._Clock(10.0, time.time() - 1000)
    rows, end = clock.read({"pass": 3})
    assert list(rows) == [(end["pass"], int(clock.begin + end["pass"] * 10.0))] and end["pass"] in (99, 100)
    assert list(clock.readBetweenOffsets(end, end)) == []
    assert clock.read({"pass": 10**9})[1] == {"pass": 10**9}


# -- watched folders ------------------------------------------------------------------

T0 = datetime(2026, 1, 1, 12, 0, 0)


def _events(spark, folder, rows):
    made = [(T0 + timedelta(seconds=s), path, MASKS[bit] | (MASKS["isdir"] if isdir else 0), project)
            for s, path, bit, isdir, project in rows]
    spark.createDataFrame(made, "ts timestamp, path string, mask int, project_id string").coalesce(1).write.mode(
        "append").parquet(folder)


def test_watched_folders_over_batches_and_restarts(spark, tmp_path):
    source, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    spark.conf.set(*wt.STATE_STORE)

    def run():
        stream = spark.readStream.schema("ts timestamp, path string, mask int, project_id string").parquet(source)
        query = wt.watch_changes(stream).writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", ck).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(120)
        state = {}
        for r in sorted(spark.read.parquet(out).collect(), key=lambda r: (r["at_ms"], r["folder"])):
            state[r["project_id"], r["folder"]] = r["watched"]
        return sorted(k for k, v in state.items() if v)

    _events(spark, source, [(0, "/p", "create", True, "p"), (1, "/p/d", "create", True, "p"),
                            (2, "/p/d/e", "create", True, "p"), (3, "/p/f.txt", "create", False, "p"),
                            (3, "/q", "create", True, "q"), (4, "/nobody", "create", True, None)])
    try:
        assert run() == [("p", "/p"), ("p", "/p/d"), ("p", "/p/d/e"), ("q", "/q")]
        # Moved away and back at once: still watched.  Deleted: with all below, known from before the restart.
        _events(spark, source, [(20, "/q", "moved_from", True, "q"), (21, "/q", "moved_to", True, "q"),
                                (22, "/p/d", "delete", True, "p"), (23, "/p/g", "moved_to", True, "p")])
        assert run() == [("p", "/p"), ("p", "/p/g"), ("q", "/q")]
        # Moved away for good: the timer fires once events have gone on past it.
        _events(spark, source, [(40, "/p/g", "moved_from", True, "p"), (40, "/q", "create", True, "q")])
        run()
        _events(spark, source, [(90, "/q/z", "create", True, "q")])
        assert run() == [("p", "/p"), ("q", "/q"), ("q", "/q/z")]
    finally:
        spark.conf.unset(wt.STATE_STORE[0])
