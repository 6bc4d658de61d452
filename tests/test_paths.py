import os
import posixpath
from pathlib import PurePosixPath

from pyspark.sql import functions as F

from treegauge.functions import paths as P

SAMPLES = ["/a", "/a/b", "/a/b.md", "/a/.bashrc", "/a/b.tar.gz", "/a/..b.c", "/a/x.", "/a.b/c",
           "/home/d/.git", "/a b/c d.TXT"]


def test_parts_agree_with_the_standard_library(spark):
    df = spark.createDataFrame([(s,) for s in SAMPLES], "path string").select(
        "path", P.basename("path").alias("b"), P.dirname("path").alias("d"),
        P.stem("path").alias("s"), P.suffix("path").alias("x"), P.type_of("path").alias("t"))
    for r in df.collect():
        base = posixpath.basename(r["path"])
        assert (r["b"], r["d"]) == (base, posixpath.dirname(r["path"]))
        assert (r["s"], r["x"]) == posixpath.splitext(base)
        suffix = PurePosixPath(base).suffix.lower()
        if not base.endswith("."):
            assert r["t"] == (suffix[1:] or "(none)")


def test_normpath_agrees_with_the_standard_library(spark):
    samples = ["/a/b/../c/./d.md", "/a//b", "/../a", "/a/b/", "/a/.b/..c", "/a/b/../..", "/x/../../y"]
    df = spark.createDataFrame([(s,) for s in samples], "p string").select(
        "p", P.normpath("p").alias("n"))
    for r in df.collect():
        assert r["n"] == os.path.normpath(r["p"])


def test_under_is_decided_at_a_separator(spark):
    df = spark.createDataFrame([("/a",), ("/a/b",), ("/ab",), ("/",)], "p string")
    assert [r[0] for r in df.filter(P.under("p", "/a")).collect()] == ["/a", "/a/b"]
    assert df.filter(P.under("p", "/a/")).count() == 1
    assert df.filter(P.under("p", "/")).count() == 4


def test_ancestors_and_relative(spark):
    df = spark.createDataFrame([("/a/b/c",), ("/a",)], "p string").select(
        P.ancestors("p").alias("a"), P.relative("p", "/a").alias("r"), F.col("p"))
    got = {r["p"]: (r["a"], r["r"]) for r in df.collect()}
    assert got == {"/a/b/c": (["/a", "/a/b"], "b/c"), "/a": ([], ".")}


def test_moved_rewrites_only_its_own_tree(spark):
    df = spark.createDataFrame([("/a/x",), ("/ab/x",), ("/a",)], "p string")
    assert [r[0] for r in df.select(P.moved("p", "/a", "/n/m")).collect()] == ["/n/m/x", "/ab/x", "/a"]
