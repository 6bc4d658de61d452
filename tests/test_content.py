import hashlib

from treegauge.operators import content as con


def test_one_reason_per_case_and_the_order_of_tests(spark):
    cases = {
        "notes.md": (b"hello \xc3\xa6", None), "image": (b"a\0b", "binary"),
        "late_nul": (b"a" * 8192 + b"\0", None), "head_nul": (b"a" * 8191 + b"\0", "binary"),
        "pgp": (b"-----BEGIN PGP MESSAGE-----\nx", "encrypted"),
        "key": (b"-----BEGIN PGP PRIVATE KEY BLOCK-----", "encrypted"),
        "age": (b"age-encryption.org/v1\0", "encrypted"), "packet": (b"\x85\x01", "encrypted"),
        "latin": (b"caf\xe9", "undecodable"), "missing": (None, "unreadable"), "empty": (b"", None),
        "inner": (b"x-----BEGIN PGP MESSAGE-----", None)}
    rows = [(p, len(raw or b""), 1, None if raw is None else bytearray(raw))
            for p, (raw, _r) in cases.items()]
    rows += [("huge", (1 << 20) + 1, 1, None), ("edge", 1 << 20, 1, bytearray(b"x"))]
    df = con.classify(spark.createDataFrame(
        rows, "path string, size bigint, mtime_ns bigint, bytes binary"))
    got = {r["path"]: r for r in df.collect()}
    for path, (raw, reason) in cases.items():
        assert got[path]["reason"] == reason, path
        if reason is None:
            assert got[path]["text"] == raw.decode()
            assert got[path]["sha256"] == hashlib.sha256(raw).hexdigest()
        else:
            assert got[path]["text"] is None and got[path]["sha256"] is None
    assert got["huge"]["reason"] == "too_large" and got["edge"]["reason"] is None
    assert con.broken_rows(df).count() == 0
    tally = {r["name"]: r["n"] for r in con.tally(df).collect()}
    assert tally == {"read": 5, "unread": 9, "binary": 2, "encrypted": 4, "undecodable": 1,
                     "unreadable": 1, "too_large": 1}


def test_copies_are_one_node_with_two_paths(spark, rows):
    df = spark.createDataFrame([("/b", "s"), ("/a", "s"), ("/c", "t"), ("/d", None)],
                               "path string, sha256 string")
    assert rows(con.nodes(df)) == [("s",), ("t",)]
    assert rows(con.node_paths(df), "sha256", "path", "n_paths") == [
        ("s", "/a", 2), ("s", "/b", 2), ("t", "/c", 1)]
    assert [r[0] for r in con.paths_of(df, "s").collect()] == ["/a", "/b"]
