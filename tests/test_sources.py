import hashlib
import os

import pytest
from pyspark.sql import functions as F

from treegauge.sources import files as readers, tree as walker


@pytest.fixture
def planted(tmp_path):
    root = tmp_path / "root"
    for name in ("a/one.md", "a/b/two.md", "c/three.md", "skip/x", "skipped/y", ".hidden/z"):
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(name)
    (root / "link").symlink_to(root / "a")
    (root / "a" / "loop").symlink_to(root)
    (root / "dangling").symlink_to(root / "nowhere")
    os.mkfifo(root / "pipe")
    return str(root)


@pytest.mark.parametrize("tasks", [1, 3, 50])
def test_walk_sees_every_entry_once_and_follows_no_link(spark, planted, tasks):
    got = walker.walk(spark, planted, tasks=tasks).collect()
    want = {}
    for folder, dirs, names in os.walk(planted):
        for name in dirs + names:
            path = os.path.join(folder, name)
            st = os.lstat(path)
            want[path] = (st.st_size, st.st_mtime_ns, st.st_ino, st.st_dev)
    assert {r["path"]: tuple(r)[2:] for r in got} == want and len(got) == len(want)
    kinds = {os.path.relpath(r["path"], planted): r["kind"] for r in got}
    assert kinds["link"] == kinds["a/loop"] == kinds["dangling"] == "link"
    assert kinds["a"] == "dir" and kinds["a/one.md"] == "file" and kinds["pipe"] == "other"


def test_denied_folders_are_pruned_counted_and_refused_as_root(spark, planted):
    walked = walker.walk(spark, planted, deny=[planted + "/skip/"])
    paths = {r["path"] for r in walker.entries(walked).collect()}
    assert planted + "/skip/x" not in paths and planted + "/skipped/y" in paths
    assert walker.walk_counts(walked).first()["pruned"] == 1
    with pytest.raises(Exception):
        walker.walk(spark, planted, deny=[planted]).count()


def test_bytes_and_hashes_are_read_by_the_task_that_owns_the_row(spark, planted):
    files = walker.entries(walker.walk(spark, planted)).filter("kind = 'file'")
    more = files.unionByName(files.limit(1).withColumn("path", F.lit(planted + "/vanished")))
    digests = {r["path"]: r["digest"] for r in readers.hash_files(more).collect()}
    assert digests[planted + "/vanished"] is None
    path = planted + "/a/b/two.md"
    assert digests[path] == hashlib.sha256(b"a/b/two.md").hexdigest()
    raw = {r["path"]: r["bytes"] for r in readers.read_bytes(more, max_bytes=9).collect()}
    assert raw[planted + "/a/one.md"] == b"a/one.md" and raw[path] is None


def test_object_storage_gives_the_same_rows(spark, tmp_path):
    # Plain files only: this source follows links, so a looping one never ends.
    (tmp_path / "one.md").write_text("short")
    (tmp_path / "two.md").write_text("longer than the cap")
    got = {r["path"]: (r["size"], bytes(r["bytes"])) for r in readers.stored_bytes(
        spark, str(tmp_path), max_bytes=9, glob="*.md").collect()}
    assert got == {str(tmp_path / "one.md"): (5, b"short")}


def test_ignore_files_come_from_the_catalogue(spark, planted):
    for name, text in ((".gitignore", b"*.log\n\xff"), ("a/.gitignore", b"x"), (".git/.gitignore", b"*")):
        path = os.path.join(planted, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as handle:
            handle.write(text)
    files = walker.entries(walker.walk(spark, planted))
    got = {r["base"]: r["text"] for r in readers.ignore_files(files).collect()}
    assert got == {planted: "*.log\n�", planted + "/a": "x"}
