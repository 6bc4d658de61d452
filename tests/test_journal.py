import pytest
from pyspark.sql import functions as F

from treegauge import Refused
from treegauge.operators import journal as jo

OLD = "path string, size bigint, mtime_ns bigint, content_hash string, hash_source string"
NEW = "path string, kind string, size bigint, mtime_ns bigint, in_scope boolean, hash_now string"


def test_every_row_of_the_truth_table(spark):
    old = spark.createDataFrame([
        ("gone", 1, 1, "x", "compared"), ("same", 1, 1, "x", "backfilled"),
        ("blind", 1, 1, "x", "compared"), ("outside", 1, 1, "x", "backfilled"),
        ("outside_cold", 1, 1, None, None), ("unread", 1, 1, "x", "compared"),
        ("cold", 1, 1, None, None), ("touch", 1, 1, "h", "backfilled"),
        ("edit", 1, 1, "x", "compared"), ("same_length", 1, 1, "x", "compared"),
        ("folder", 1, 1, None, None)], OLD)
    new = spark.createDataFrame([
        ("in", "file", 1, 1, True, "h"), ("in_unread", "file", 1, 1, True, None),
        ("out", "file", 1, 1, False, "h"), ("same", "file", 1, 1, True, "h"),
        ("blind", "file", 1, 1, True, "other"), ("outside", "file", 2, 1, False, "h"),
        ("outside_cold", "file", 2, 1, False, "h"), ("unread", "file", 1, 2, True, None),
        ("cold", "file", 2, 1, True, "h"), ("touch", "file", 1, 2, True, "h"),
        ("edit", "file", 2, 2, True, "h"), ("same_length", "file", 1, 2, True, "h"),
        ("folder", "dir", 1, 2, True, "h")], NEW)
    got = {r["path"]: (r["state"], r["content_hash"], r["hash_source"])
           for r in jo.compare(old, new).collect()}
    assert got == {
        "in": ("added", "h", "compared"), "in_unread": ("added", None, None),
        "out": ("added", None, None), "gone": ("removed", None, None),
        "same": ("unchanged", "x", "backfilled"), "blind": ("unchanged", "x", "compared"),
        "outside": ("unconfirmed", "x", "backfilled"),
        "outside_cold": ("unconfirmed", None, None), "unread": ("unconfirmed", "x", "compared"),
        "cold": ("unconfirmed", "h", "compared"), "touch": ("touched", "h", "compared"),
        "edit": ("changed", "h", "compared"), "same_length": ("changed", "h", "compared"),
        "folder": ("unconfirmed", None, None)}
    moved = {r["path"] for r in jo.moved(old, new).collect()}
    assert moved == {p for p, (s, _h, _s) in got.items() if s not in ("removed", "unchanged")}
    tally = jo.tally_row(jo.compare(old, new)).first().asDict()
    assert tally == {"added": 3, "removed": 1, "unchanged": 2, "changed": 2, "touched": 1,
                     "unconfirmed": 5}


def _files(spark):
    return spark.createDataFrame([
        ("a", "file", 10, None, None), ("b", "file", 20, None, None), ("c", "file", 5, "x", "compared"),
        ("out", "file", 7, None, None), ("d", "dir", 0, None, None), ("e", "file", 3, "y", "backfilled")],
        "path string, kind string, size bigint, content_hash string, hash_source string")


def test_backfill_fills_only_cold_rows_in_scope(spark):
    files, scope = _files(spark), F.col("path") != "out"
    hashes = spark.createDataFrame([("a", "h"), ("b", None), ("c", "z"), ("out", "z")],
                                   "path string, digest string")
    done = jo.backfill(files, scope, hashes)
    got = {r["path"]: (r["content_hash"], r["hash_source"]) for r in done.collect()}
    assert got == {"a": ("h", "backfilled"), "b": (None, None), "c": ("x", "compared"),
                   "out": (None, None), "d": (None, None), "e": ("y", "backfilled")}
    assert jo.cold_report(files, scope).first().asDict() == {"files": 2, "bytes": 30}
    assert jo.backfill_report(files, scope, hashes).first().asDict() == {
        "files": 2, "bytes": 30, "hashed": 1, "unreadable": 1}
    again = jo.backfill(done, scope, hashes)
    assert sorted(map(tuple, again.collect()), key=repr) == sorted(map(tuple, done.collect()), key=repr)


def test_coverage_is_split_and_never_divides_by_zero(spark):
    cover = jo.hash_coverage(_files(spark), F.col("path") != "out").first().asDict()
    assert cover == {"in_scope": 4, "hashed": 2, "compared": 1, "backfilled": 1, "percent": 50.0,
                     "migrated": True}
    assert jo.hash_coverage(_files(spark), F.lit(False)).first()["percent"] == 0.0
    assert not jo.hash_coverage(_files(spark).drop("hash_source"), F.lit(True)).first()["migrated"]


def test_the_ceiling_refuses_before_any_work(spark):
    with pytest.raises(Refused):
        jo.refuse_over(jo.cold_rows(_files(spark), F.lit(True)), 2)
    jo.refuse_over(jo.cold_rows(_files(spark), F.lit(True)), 3)
