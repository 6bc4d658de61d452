import datetime as dt

from pyspark.sql import functions as F

from treegauge.functions import times as T
from treegauge.operators import (catalogue as cat, equivalence as eq, freshness as fr, identity as idn,
                                 snapshots as sn, tree as tr)

CONTENT = "path string, mtime_ns bigint, sha256 string, text string, reason string"


def _layer(spark):
    return spark.createDataFrame([
        ("/p/fresh", 1, "s", "x", None), ("/p/edited", 1, "s", "x", None), ("/p/unread", 1, None, None, "binary"),
        ("/p/new", 1, "n", "x", None), ("/p/blank", 1, "e", "\n  ", None), ("/p/gone", 1, "s", "x", None),
        ("/p/d/edited_new", 1, "n", "x", None)], CONTENT)


def _now(spark):
    return spark.createDataFrame([(p, "file", 2 if "edited" in p else 1) for p in (
        "/p/fresh", "/p/edited", "/p/unread", "/p/new", "/p/blank", "/p/d/edited_new", "/p/pending")],
        "path string, kind string, mtime_ns bigint")


def test_four_states_and_their_precedence(spark):
    have = spark.createDataFrame([("s",)], "sha256 string")
    states = fr.per_file(_layer(spark), _now(spark), have)
    assert {r["path"]: r["state"] for r in states.collect()} == {
        "/p/fresh": "fresh", "/p/edited": "stale", "/p/unread": "unread", "/p/new": "unembedded",
        "/p/blank": "fresh", "/p/gone": "stale", "/p/d/edited_new": "stale"}
    assert fr.tally(states).first().asDict() == {"fresh": 2, "stale": 3, "unread": 1, "unembedded": 1,
                                                 "unknown": 0}
    blind = {r["path"]: r["state"] for r in fr.per_file(_layer(spark), None, have).collect()}
    assert blind["/p/edited"] == blind["/p/gone"] == "fresh"


def test_directories_count_direct_children_only(spark):
    have = spark.createDataFrame([("s",)], "sha256 string")
    states = fr.per_file(_layer(spark), _now(spark), have)
    journal = spark.createDataFrame([
        ("/p/pending", "added"), ("/p/edited", "changed"), ("/p/other/x", "removed"),
        ("/p/only/y", "added"), ("/p/same", "unchanged"), ("/p/dir", "changed")], "path string, state string")
    files = _now(spark).unionByName(spark.createDataFrame(
        [("/p/only/y", "file", 1), ("/p/dir", "dir", 1)], "path string, kind string, mtime_ns bigint"))
    pending = fr.pending_by_dir(journal, files, _layer(spark))
    assert {r["dir"]: r["pending"] for r in pending.collect()} == {"/p": 1, "/p/only": 1}
    got = fr.worst_first(fr.per_dir(states, pending)).withColumn("line", fr.describe_dir("/p")).collect()
    assert [(r["dir"], r["total"], r["not_fresh"], r["pending"]) for r in got] == [
        ("/p", 6, 4, 1), ("/p/d", 1, 1, 0)]
    assert got[0]["line"] == "%-40s 2/6 fresh, 2 stale, 1 unread, 1 unembedded, 1 pending" % "."
    mixture = fr.dir_mixture(states).first().asDict()
    assert (mixture["dirs"], mixture["mixed"], mixture["not_fresh_dirs"]) == (2, 1, 2)


def test_ages_in_words(spark):
    cases = [(-5.0, T.FUTURE), (-0.5, "0 s"), (0.0, "0 s"), (89.9, "89 s"), (90.0, "1 min"),
             (5399.0, "89 min"), (5400.0, "1 h"), (172799.0, "47 h"), (172800.0, "2 d"), (None, T.NEVER)]
    df = spark.createDataFrame(cases, "s double, want string").withColumn("got", T.human(F.col("s")))
    assert all(r["got"] == r["want"] for r in df.collect())
    stamps = spark.createDataFrame([
        ("a", "1000", "1970-01-01T00:16:00", None, True), ("b", "", "no time", "1000", False)],
        "store string, catalogue string, content string, vectors string, vectors_open boolean")
    got = {r["store"]: r["line"] for r in fr.layer_ages(stamps, F.lit(1060.0)).collect()}
    assert got == {"a": "catalogue 60 s  content 1 min  vectors never built",
                   "b": "catalogue never built  content stamp unreadable  vectors layer not read"}


def test_identity_verdicts(spark):
    def tree(root, *files):
        return [("%s/%s" % (root, n), "file", s, 0, 0) for n, s in files]
    same = (("a", 1), ("sub/b", 2))
    files = spark.createDataFrame(
        tree("/n/moved", *same) + tree("/n/one", ("x", 9)) + tree("/n/two", ("x", 9)) +
        tree("/n/here", ("k", 4)) + tree("/n/reused", ("q", 7)) + tree("/n/inode", ("z", 5)) +
        tree("/n/inode_copy", ("z", 5)) +
        [(d, "dir", 0, i, 1) for i, d in enumerate(
            ["/n/moved", "/n/one", "/n/two", "/n/here", "/n/reused", "/n/inode", "/n/inode_copy"], 10)],
        "path string, kind string, size bigint, inode bigint, dev bigint")
    projects = spark.createDataFrame([
        ("moved", "/o/moved", 1, 99), ("twice", "/o/x", None, None), ("here", "/n/here", 1, 13),
        ("lost", "/o/lost", 1, 14), ("empty", "/o/empty", 1, 10), ("inode", "/o/inode", 1, 15)],
        "project_id string, path string, root_dev bigint, root_inode bigint")
    held = spark.createDataFrame(
        [("moved", "/o/moved", "/o/moved/" + n, s) for n, s in same] +
        [("twice", "/o/x", "/o/x/x", 9), ("here", "/n/here", "/n/here/k", 4),
         ("lost", "/o/lost", "/o/lost/other", 7), ("inode", "/o/inode", "/o/inode/z", 5)],
        "project_id string, root string, path string, size bigint")
    got = {r["project_id"]: (r["verdict"], r["path"], r["candidates"], r["by"])
           for r in idn.recognise(projects, held, files).collect()}
    assert got == {
        "moved": ("move", "/n/moved", 1, "fingerprint"), "twice": ("ambiguous", None, 2, "fingerprint"),
        "here": ("present", "/n/here", 1, None), "lost": ("deleted", None, 0, None),
        "empty": ("deleted", None, 0, None), "inode": ("move", "/n/inode", 1, "inode")}
    same_dirs = idn.same_trees(idn.tree_fingerprints(files)).collect()
    assert {(r["dirs"], r["first_dir"]) for r in same_dirs} == {(2, "/n/one"), (2, "/n/inode")}


def test_verdict_table(spark):
    df = spark.createDataFrame([(True, True), (False, True), (True, False), (False, False)],
                               "o boolean, n boolean")
    got = [r[0] for r in df.select(idn.verdict(F.col("o"), F.col("n"))).collect()]
    assert got == ["copy", "move", "present", "deleted"]


def test_retention_floor_window_and_warning(spark, rows):
    now = dt.datetime(2024, 6, 30)
    def at(days):
        return now - dt.timedelta(days=days)
    snaps = spark.createDataFrame(
        [("live", "l%d" % d, at(d), True) for d in (1, 14, 15, 20, 30)] +
        [("dead", "d%d" % d, at(d), False) for d in (3, 13, 20)] +
        [("old", "o%d" % d, at(d), True) for d in (40, 50)],
        "project_id string, snapshot_id string, taken_at timestamp, living boolean")
    got = sn.retention(snaps, F.lit(now))
    assert {r["snapshot_id"] for r in got.filter("keep").collect()} == {
        "l1", "l14", "l15", "d3", "d13", "o40", "o50"}
    assert rows(sn.expiring(snaps.filter("snapshot_id <> 'd20'"), F.lit(now))) == [("dead", 1.0)]
    copies = spark.createDataFrame([("p", "a", at(2), True), ("p", "b", at(1), False)],
                                   "project_id string, snapshot_id string, taken_at timestamp, intact boolean")
    assert sn.restorable(copies).first()["snapshot_id"] == "a"


def test_buckets_take_over_crowded_folders(spark, rows):
    paths = ["/r/a/%d.md" % i for i in range(3)] + ["/r/a/x.TXT", "/r/a/noext", "/r/b/c/one.md",
                                                    "/r/top.md", "/r/b/1", "/r/b/2", "/r/b/3", "/r/b/4"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    nodes = {r["id"]: r for r in tr.nodes(df, "/r").collect()}
    edges = {(r["from"], r["to"]) for r in tr.edges(df, "/r").collect()}
    assert len(nodes) == len(edges) + 1
    assert ("a", "a\0md") in edges and ("a\0md", "a/0.md") in edges and ("a\0txt", "a/x.TXT") in edges
    assert nodes["a/0.md"]["depth"] == 3 and nodes["a\0md"]["depth"] == 2
    assert ("b", "b/1") in edges and nodes["b/1"]["depth"] == 2  # four files are not crowded
    assert ("", "top.md") in edges and nodes[""]["name"] == "." and nodes["b/c"]["depth"] == 2
    tally = {(r["kind"], r["state"]): r["n"] for r in tr.tally(tr.nodes(df, "/r")).collect()}
    assert tally == {("dir", None): 4, ("bucket", None): 3, ("file", "fresh"): 11}
    weights = {(r["from"], r["to"]): r["weight"] for r in tr.link_weights(tr.edges(df, "/r")).collect()}
    assert weights[("", "top.md")] == 1 / (3 + 1) and weights[("b", "b/c")] == 1 / (6 + 2)


def test_seed_positions_agree_with_a_sequential_placement(spark):
    from tests_support import mulberry

    paths = ["/r/a/%d.md" % i for i in range(6)] + ["/r/b/c/d.md", "/r/z"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    ids = sorted(r["id"] for r in tr.nodes(df, "/r").collect())
    parent = {r["to"]: r["from"] for r in tr.edges(df, "/r").collect()}
    draw, want = mulberry(1337), {}
    for i in ids:
        x, y = (draw() - 0.5) * 2, (draw() - 0.5) * 2
        px, py = want[parent[i]] if i in parent else (0.0, 0.0)
        want[i] = (px + x, py + y)
    got = {r["id"]: (r["x"], r["y"]) for r in tr.seed_positions(df, "/r").collect()}
    assert set(got) == set(want)
    assert all(abs(got[i][k] - want[i][k]) < 1e-9 for i in ids for k in (0, 1))
    box = tr.extent(tr.seed_positions(df, "/r")).first()
    assert box["min_x"] == min(x for x, _y in got.values())
    near = tr.nearest(tr.seed_positions(df, "/r"), *got["z"]).first()
    assert near["id"] == "z" and near["distance"] == 0


def test_equivalence_names_each_side(spark, rows):
    def store(content, meta):
        return {"content": spark.createDataFrame(content, "path string, sha256 string, reason string"),
                "meta": spark.createDataFrame(meta, "key string, value string")}
    a = store([("x", "1", None), ("y", None, "binary")], [("k", "1"), ("embed_at", "9")])
    b = store([("x", "1", None), ("y", None, None)], [("k", "1"), ("embed_at", "8")])
    assert eq.differences(a, a).count() == 0
    assert rows(eq.summary(eq.differences(a, b))) == [("content", 1, 1)]


def test_summary_ratio_uses_the_upper_median(spark):
    files = spark.createDataFrame(
        [("/r/a/%d" % i, "file") for i in range(40)] + [("/r/b/x", "file"), ("/r/b/y", "file")] +
        [(d, "dir") for d in ("/r/a", "/r/b", "/r/c", "/r/d")], "path string, kind string")
    got = cat.summary_ratio(files).first().asDict()
    assert got == {"files": 42, "dirs": 4, "ratio": 10.5, "median_files_per_dir": 2, "dirs_over": 1,
                   "pct_over": 25.0}
    assert cat.summary_ratio(files.limit(0)).first()["ratio"] == 0.0


def test_name_search_and_mounts(spark, rows):
    files = spark.createDataFrame([("/a/Red_File.md", "file"), ("/a/redXfile.md", "file"),
                                   ("/a/b/red_file", "dir"), ("/a/x", "file")], "path string, kind string")
    assert [r["path"] for r in cat.name_search(files, "RED_file").collect()] == [
        "/a/b/red_file", "/a/Red_File.md", "/a/redXfile.md"]
    assert cat.name_search(files, "!!").count() == 0
    mounts = spark.createDataFrame([("/", "ext4", 1), ("/a", "nfs", 2), ("/a", "btrfs", 3), ("/a/b", "tmp", 4)],
                                   "mount string, fstype string, line_no int")
    got = dict(rows(cat.mount_of(files.select("path"), mounts)))
    assert got == {"/a/Red_File.md": "btrfs", "/a/redXfile.md": "btrfs", "/a/b/red_file": "tmp", "/a/x": "btrfs"}
    assert cat.knows(files, "/a/b") and not cat.knows(files, "/a/r")


def test_no_folder_over_all_files_meets_one_task(spark):
    """Trees are matched by combined rows: the files of a folder are not joined with it by its name."""
    files = spark.range(400).selectExpr("concat('/r/d', id div 2, '/', id % 2) AS path", "'file' AS kind", "id AS size",
                                        "1 AS dev", "id AS inode")
    dirs = spark.range(200).selectExpr("concat('/r/d', id) AS path", "'dir' AS kind", "0L AS size", "1 AS dev", "id AS inode")
    projects = spark.range(200).selectExpr("id AS project_id", "concat('/gone/d', id) AS path", "1 AS root_dev", "id AS root_inode")
    content = files.selectExpr("size div 2 AS project_id", "concat('/gone/d', size div 2) AS root",
                               "concat('/gone/d', size div 2, '/', size % 2) AS path", "size")
    got = idn.recognise(projects, content, files.unionByName(dirs))
    assert "_lookup_dir" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["verdict"], r["by"], r["path"] == "/r/d%d" % r["project_id"]) for r in got.collect()} == {("move", "inode", True)}
