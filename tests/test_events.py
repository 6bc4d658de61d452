import datetime as dt
import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from treegauge import Refused
from treegauge.streaming import events as evt, service as svc

T0 = dt.datetime(2024, 1, 1)


def _sessions(stamps, gap):
    out = []
    for at in sorted(stamps):
        if out and (at - out[-1][-1]).total_seconds() <= gap:
            out[-1].append(at)
        else:
            out.append([at])
    return out


def test_bursts_agree_with_a_sequential_reading(spark):
    rng = random.Random(5)
    stamps, at = [], T0
    for _ in range(400):
        # Mostly short pauses; some reach over midnight, some skip days.
        at += dt.timedelta(seconds=rng.choice([0.5, 2, 2, 40, 3600, 3600 * 30]))
        stamps.append((at, "p%d" % rng.randrange(4)))
    # One unbroken burst over three midnights.
    long_run = T0 + dt.timedelta(days=400)
    stamps += [(long_run + dt.timedelta(seconds=2 * i), "run") for i in range(0, 3 * 43200, 1)]
    df = spark.createDataFrame(stamps, "ts timestamp, project_id string").repartition(5)
    for gap in (2, 3600):
        want = _sessions([s for s, _p in stamps], gap)
        totals, hits = svc.bursts(df, gap)
        got = sorted(tuple(r) for r in totals.collect())
        assert got == [(s[0], s[-1], len(s)) for s in want]
        owner = {}
        for s in want:
            for moment in s:
                owner[moment] = s[0]
        assert {tuple(r) for r in hits.collect()} == {(owner[s], p) for s, p in stamps}


def test_keep_order_and_guards(spark):
    stores = ["/w/store/p1/index.db"]
    cases = {"/w/store/p1/index.db": False, "/w/store/p1/index.db-wal": False,
             "/w/store/p1/index.db.lock": False, "/w/store/p1": False, "/w/store/p1/other": False,
             "/w/store/p10/x": True, "/w/a/.gitignore": True, "/w/out/.gitignore": True,
             "/w/a/.git/": True, "/w/out/x.md": False, "/w/a/x.md": True}
    df = spark.createDataFrame(list(cases.items()), "path string, want boolean").withColumn(
        "got", evt.keep("path", stores, ~F.contains("path", F.lit("/out/"))))
    assert [r["path"] for r in df.collect() if r["got"] != r["want"]] == []
    # The table form gives the same, whatever its length, and repeated stores do not repeat events.
    table = spark.createDataFrame(
        [(s,) for s in stores * 2] + [("/v/%d/index.db" % i,) for i in range(500)], "path string")
    kept = evt.with_kept(df, table, ~F.contains("path", F.lit("/out/")))
    assert {r["path"]: r["kept"] for r in kept.collect()} == cases and kept.count() == len(cases)
    none = evt.with_kept(df, table.limit(0), F.lit(True))
    assert none.filter("kept").count() == len(cases)


def test_the_innermost_project_owns_an_event(spark):
    projects = spark.createDataFrame([("out", "/w"), ("in", "/w/in"), ("deep", "/w/in/x/y")],
                                     "project_id string, path string")
    want = {"/w/a": "out", "/w/in": "in", "/w/in/a": "in", "/w/inner/a": "out", "/w/in/x/y/z": "deep",
            "/w/in/x/a": "in", "/v/a": None}
    df = spark.createDataFrame([(p,) for p in want], "path string")
    assert {r["path"]: r["project_id"] for r in evt.attribute(df, projects).collect()} == want
    roots = {r["path"]: r["project_id"] for r in projects.collect()}
    assert {r["path"]: r["o"] for r in df.select("path", evt.owner("path", roots).alias("o")).collect()} == want


def test_mask_bits(spark):
    df = spark.createDataFrame([(0x40000100,), (0x400,), (0x4000,), (0x8,)], "mask int").select(
        evt.named_bits("mask").alias("n"), evt.is_own_end("mask").alias("e"))
    assert [(r["n"], r["e"]) for r in df.collect()] == [
        (["create", "isdir"], False), (["delete_self"], True), (["overflow"], True),
        (["close_write"], False)]


def _write_events(spark, folder, rows):
    spark.createDataFrame(rows, "ts timestamp, path string, mask int").repartition(3).write.mode(
        "append").parquet(folder)


def test_stream_bursts_equal_batch_bursts(spark, tmp_path):
    rng = random.Random(1)
    rows, at = [], T0
    for i in range(200):
        at += dt.timedelta(seconds=rng.choice([1, 1, 2, 9]))
        rows.append((at, "/w/p%d/f" % rng.randrange(3), 8))
    _write_events(spark, str(tmp_path / "in"), rows)
    roots = {"/w/p0": "p0", "/w/p1": "p1", "/w/p2": "p2"}
    stream = evt.event_stream(spark, str(tmp_path / "in")).select(
        "ts", evt.owner("path", roots).alias("project_id"))
    run = (svc.stream_bursts(stream, "2 seconds").writeStream.outputMode("complete").format("memory")
           .queryName("bursts").option("checkpointLocation", str(tmp_path / "ck"))
           .trigger(availableNow=True).start())
    run.awaitTermination(120)
    got = sorted((r["start"], r["events"]) for r in spark.table("bursts").collect())
    want = _sessions([r[0] for r in rows], 2)
    assert got == [(s[0], len(s)) for s in want]


def test_serve_updates_each_hit_project_and_survives_a_refusal(spark, tmp_path):
    folder = str(tmp_path / "in")
    _write_events(spark, folder, [(T0, "/w/a/x", 8), (T0, "/w/a/y", 8), (T0, "/w/b/.gitignore", 8),
                                  (T0, "/w/c/out", 8), (T0, "/v/x", 8)])
    roots = {"/w/a": "a", "/w/b": "b", "/w/c": "c"}
    done = []

    def kept(batch):
        return batch.filter(evt.keep("path", [], ~F.endswith("path", F.lit("out")))).select(
            evt.owner("path", roots).alias("project_id"))

    def update(project):
        done.append(project)
        if project == "a":
            raise Refused("refused")

    svc.serve(evt.event_stream(spark, folder), kept, update, str(tmp_path / "ck")).awaitTermination(120)
    assert done == ["a", "b"]

    def broken(project):
        raise OSError("the disk is full")

    # Any other failure fails the batch; a restart replays it.
    query = svc.serve(evt.event_stream(spark, folder), kept, broken, str(tmp_path / "again"))
    with pytest.raises(StreamingQueryException):
        query.awaitTermination(120)
    done.clear()
    svc.serve(evt.event_stream(spark, folder), kept, update, str(tmp_path / "again")).awaitTermination(120)
    assert done == ["a", "b"]


def test_sweep_reports_unwatched_projects(spark, rows):
    journal = spark.createDataFrame([("/w/a/x", "changed"), ("/w/b/x", "added"), ("/w/c/x", "unchanged")],
                                    "path string, state string")
    projects = spark.createDataFrame([("a", "/w/a", True), ("b", "/w/b", False), ("c", "/w/c", True)],
                                     "project_id string, path string, watch boolean")
    assert rows(svc.sweep_hits(journal, projects, lambda df: df)) == [("a", True), ("b", False)]


def test_a_journal_reads_as_events(spark):
    journal = spark.createDataFrame([("/a", "added"), ("/b", "removed"), ("/c", "touched"), ("/d", "unchanged")],
                                    "path string, state string")
    got = {r["path"]: r["mask"] for r in evt.journal_events(journal, F.lit(T0)).collect()}
    assert got == {"/a": 0x100, "/b": 0x200, "/c": 0x8}


def test_sweep_windows(spark):
    df = spark.createDataFrame([(T0 + dt.timedelta(minutes=m), "p") for m in (0, 29, 30, 95)],
                               "ts timestamp, project_id string")
    got = [(r["start"].hour * 60 + r["start"].minute, r["events"], r["about_projects"])
           for r in svc.sweep_windows(df).orderBy("start").collect()]
    assert got == [(0, 2, 1), (30, 1, 1), (90, 1, 1)]
