import glob
import os
import time

import pytest
from pyspark.errors import PySparkException

from treegauge import Refused
from treegauge.operators import embed
from treegauge.plans.workspace import Workspace


def _put(root, name, text):
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as handle:
        handle.write(text)
    return path


def test_a_project_from_first_scan_to_restore(spark, tmp_path):
    home, root = str(tmp_path / "home"), str(tmp_path / "home" / "proj")
    _put(root, ".git/HEAD", "x")
    _put(root, ".gitignore", "*.log\n")
    heron = _put(root, "docs/heron.md", "the heron stands in shallow water, see [[stone]]")
    _put(root, "docs/stone.md", "a stone in the river")
    _put(root, "code.py", "def getWaterLevel(): pass")
    _put(root, "noise.log", "heron heron heron")
    _put(root, "image.bin", "a\0b")
    ws = Workspace(spark, str(tmp_path / "store"), embed.hashing_model(16), "hash", 16)

    with pytest.raises(Refused):
        ws.catalogue()
    with pytest.raises(Refused):
        ws.add(root + "/absent")
    project = ws.add(root)
    with pytest.raises(Refused):
        ws.update(project)  # nothing is catalogued yet
    first = ws.scan(home)
    assert first["journal"]["added"] == first["kept"] and first["journal"]["unchanged"] == 0
    assert ws.hash_coverage()["hashed"] == 5 and ws.hash_coverage()["percent"] < 100.1

    with pytest.raises(Refused):
        ws.search("heron", project)  # never built is not "no hits"
    built = ws.update(root)
    assert built["content"] == {"read": 4, "unread": 1, "binary": 1}
    assert built["links"]["edges"] == 1 and built["links"]["derived"] == 1
    assert [r["path"] for r in ws.search("heron", project).collect()] == [heron]
    hit = ws.search("water level", project).first()
    assert (os.path.basename(hit["path"]), hit["place"]) == ("code.py", "symbols")
    assert ws.search("stone.md", names=True).count() == 1
    with pytest.raises(Refused):
        ws.search("x", project, semantic=True, fused=True)
    with pytest.raises(Refused):
        ws.search("heron", project, semantic=True)

    assert ws.embed(project)["embedded"] == 4
    again = ws.embed(project)
    assert again["embedded"] == 0 and again["reused"] == 4
    top = ws.search("heron stands shallow", project, semantic=True).first()
    assert top["path"] == heron
    fused = ws.search("heron", project, fused=True).collect()
    assert fused[0]["path"] == heron and fused[0]["route"] == "both"

    status = ws.status(project)
    assert status["freshness"]["fresh"] == 4 and status["freshness"]["unread"] == 1
    assert status["index"]["state"] == "ok" and status["in_scope"] == 5
    assert status["embedded"] == {"embedded": 4, "expected": 4}
    assert "vectors" in status["ages"] and "never" not in status["ages"]

    time.sleep(0.01)
    _put(root, "docs/stone.md", "a pebble in the river")
    _put(root, "docs/new.md", "fresh words")
    os.utime(heron, ns=(1, 1))
    second = ws.scan(home)["journal"]
    assert (second["changed"], second["touched"], second["added"], second["removed"]) == (1, 1, 1, 0)
    behind = {os.path.relpath(r["dir"], root): (r["stale"], r["pending"])
              for r in ws.stale(project).collect()}
    assert behind["docs"] == (2, 1)
    snapshot = ws.snapshot(project)
    ws.update(project)
    assert ws.search("pebble", project).count() == 1
    assert {r["dir"] for r in ws.stale(project).collect()} == {root, root + "/docs"}

    tally = {(r["kind"], r["state"]): r["n"] for r in ws.view(project, str(tmp_path / "view")).collect()}
    assert tally[("file", "unembedded")] == 2 and tally[("file", "unread")] == 1
    with pytest.raises(Refused):
        ws.view(project, root + "/view")

    ws.mark_deleted(project)
    with pytest.raises(Refused):
        ws.update(project)
    assert ws.expiring(time.time() + 13 * 86400).count() == 1
    assert ws.restore(project) == snapshot
    assert ws.search("pebble", project).count() == 0  # the frozen layers are back
    assert ws.apply_retention(time.time() + 30 * 86400) == []  # the floor protects the living
    ws.mark_deleted(project)
    assert ws.apply_retention(time.time() + 30 * 86400) == [snapshot]


def test_a_moved_project_is_recognised_and_refused_where_it_was(spark, tmp_path):
    home = str(tmp_path / "home")
    old, new = home + "/old", home + "/new"
    _put(old, "a.md", "one")
    _put(old, "b/c.md", "two two")
    ws = Workspace(spark, str(tmp_path / "store"))
    project = ws.add(old)
    ws.scan(home)
    ws.update(project)
    os.rename(old, new)
    ws.scan(home)
    found = ws.recognise(project)
    assert (found["verdict"], found["path"], found["by"]) == ("move", new, "inode")
    with pytest.raises(Refused, match="move"):
        ws.update(project)
    ws.apply_move(project, new)
    assert ws.resolve(new) == project
    assert ws.update(project)["content"]["read"] == 2
    with pytest.raises(Refused):
        ws.attempt("embed", ws.embed, project)  # no model is configured
    assert [(r["command"], r["refused"]) for r in ws.refusals().collect()] == [("embed", 1)]


def test_backfill_is_bounded_and_separate_from_the_journal(spark, tmp_path):
    home = str(tmp_path / "home")
    for i in range(3):
        _put(home + "/p", "f%d.md" % i, "text %d" % i)
    ws = Workspace(spark, str(tmp_path / "store"))
    ws.scan(home)  # nothing is registered, so nothing is hashed
    ws.add(home + "/p")
    assert ws.hash_coverage()["hashed"] == 0
    assert ws.backfill(dry_run=True)["files"] == 3
    with pytest.raises(Refused):
        ws.backfill(max_files=2)
    assert ws.backfill()["hashed"] == 3
    cover = ws.hash_coverage()
    assert (cover["backfilled"], cover["compared"]) == (3, 0)
    assert ws.scan(home)["journal"]["unchanged"] > 0
    assert ws.hash_coverage()["backfilled"] == 3


def test_commands_exit_with_what_happened(spark, tmp_path, capsys):
    from treegauge.__main__ import main

    home = str(tmp_path / "home")
    _put(home + "/p", "f.md", "some words")
    store = ["--store", str(tmp_path / "store")]
    assert main(store + ["search", "f.md", "--names"]) == 2  # nothing catalogued
    assert main(store + ["scan", home]) == 0
    assert main(store + ["add", home + "/p"]) == 0
    capsys.readouterr()
    assert main(store + ["search", "f.md", "--names"]) == 0
    assert "/p/f.md" in capsys.readouterr().out
    assert main(store + ["backfill", "--max-files", "0"]) == 3
    assert main(store + ["update", "nobody"]) == 2
    assert main(store + ["search", "f", "--semantic", "--fused"]) == 2
    capsys.readouterr()
    assert main(store + ["status"]) == 0
    assert '"layers": []' in capsys.readouterr().out


def test_snapshots_verify_by_digest_and_retention_frees_the_rest(spark, tmp_path, monkeypatch):
    from treegauge.operators import snapshots as sn

    home = str(tmp_path / "home")
    _put(home + "/p", "a.md", "one heron")
    ws = Workspace(spark, str(tmp_path / "store"))
    project = ws.add(home + "/p")
    ws.scan(home)
    ws.update(project)
    path = home + "/p"
    first = ws.snapshot(project)
    assert ws.free() == []
    ws.update(project)  # other versions; the first ones are the snapshot's
    kept = ws.retire(project)
    with pytest.raises(Refused):
        ws.search("heron", project)  # released
    assert ws.verify(first, project, path) and ws.verify(kept, project, path)

    # A job that was lost says nothing about files.
    def lost(layer):
        raise PySparkException("Job aborted: executor 3 was lost")
    with monkeypatch.context() as patch:
        patch.setattr(sn, "digest", lost)
        with pytest.raises(PySparkException):
            ws.restore(project)

    # A damaged file, one with other rows, and one that is gone are found; the older snapshot is taken.
    content = ws.meta("snapshot:" + kept)["was:layer:content"]
    part = glob.glob(content + "/*.parquet")[0]
    with open(part, "rb") as handle:
        whole = handle.read()
    os.remove(glob.glob(content + "/.*.parquet.crc")[0])
    with open(part, "wb") as handle:
        handle.write(whole[:len(whole) // 2])
    assert not ws.verify(kept, project, path)
    spark.read.parquet(ws.meta("snapshot:" + first)["was:layer:content"]).selectExpr(
        "* except (text)", "'two' as text").write.mode("overwrite").parquet(content)
    assert not ws.verify(kept, project, path)
    assert ws.restore(project) == first
    assert ws.search("heron", project).count() == 1

    # Outside the window nothing names the second versions any more.
    ws.set_meta("snapshot:" + kept, dropped=1)
    gone = ws.free()
    assert {g.split("/")[1] for g in gone} == {"content", "links", "edges", "index"}
    assert not os.path.exists(content) and ws.free() == []
    assert ws.verify(first, project, path) and ws.search("heron", project).count() == 1


def test_digests_tell_rows_places_of_nulls_and_repeats_apart(spark):
    from treegauge.operators import snapshots as sn

    make = lambda rows: sn.digest(spark.createDataFrame(rows, "a string, b string"))
    rows = [("x", None), (None, "x"), ("y", "z")]
    assert make(rows) == make(rows[::-1]) and make([]) == "0:0:0"
    assert len({make(r) for r in (rows, rows[:2], rows + rows[:1], [rows[0]], [rows[1]], [("y", "w")])}) == 6
