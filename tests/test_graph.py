from treegauge.operators import graph as gr

CONTENT = "path string, sha256 string, text string"


def _content(spark, files):
    return spark.createDataFrame(
        [(p, "sha-" + (t if s is None else s), t) for p, t, s in files], CONTENT)


def _edges(spark, files, root="/r"):
    found = gr.resolve(_content(spark, files), root)
    return ({(r["src"], r["dst"]): (r["method"], r["confidence"]) for r in gr.edges(found).collect()},
            gr.link_tally(found).first().asDict())


def test_resolution_by_path_by_name_and_refusal(spark):
    files = [
        ("/r/a.md", "[[b]] [[gone]] ![i](sub/c.md) [t](sub/c.md#x) [w](https://x.org)", "a"),
        ("/r/b.md", "[c](./sub/../sub/c.md) [[sub/c.md|alias]] [[x#h]]", "b"),
        ("/r/sub/c.md", "[[twin]] [up](../a.md) [r](b.md) [abs](/r/a.md)", "c"),
        ("/r/one/twin.md", "same", "t"), ("/r/two/twin.md", "same", "t"),
        ("/r/one/dup.md", "d1", "d1"), ("/r/two/dup.md", "d2", "d2"),
        ("/r/side.md", "s", "s"), ("/r/side.txt", "e", "e"),
        ("/r/q.md", "[[dup]] [[side]] [[]]", "q")]
    edges, tally = _edges(spark, files)
    assert edges == {
        ("sha-a", "sha-b"): ("md_wikilink_unique", 0.9), ("sha-a", "sha-c"): ("md_inline", 1.0),
        ("sha-b", "sha-c"): ("md_wikilink_path", 1.0), ("sha-c", "sha-t"): ("md_wikilink_unique", 0.9),
        ("sha-c", "sha-a"): ("md_inline", 1.0), ("sha-c", "sha-b"): ("md_inline", 1.0),
        ("sha-q", "sha-s"): ("md_wikilink_same_ext", 0.9)}
    assert tally == {"edges": 7, "stated": 6, "derived": 3, "ambiguous": 1, "outside": 2}


def test_a_stated_link_upgrades_a_guess(spark):
    edges, _tally = _edges(spark, [("/r/a.md", "[[b]] and later [b](b.md)", "a"), ("/r/b.md", "x", "b")])
    assert edges == {("sha-a", "sha-b"): ("md_inline", 1.0)}


def test_without_a_root_only_the_own_folder_counts(spark):
    files = [("/r/sub/a.md", "[b](b.md)", "a"), ("/r/b.md", "x", "b")]
    assert _edges(spark, files, None)[0] == {}
    assert ("sha-a", "sha-b") in _edges(spark, files)[0]


def test_neighbours_use_edges_back_and_fold_provenance(spark):
    edges = spark.createDataFrame([
        ("a", "b", "link", "md_inline", 1.0), ("b", "a", "link", "md_inline", 1.0),
        ("b", "c", "link", "md_wikilink_unique", 0.9), ("c", "d", "link", "md_inline", 1.0),
        ("z", "a", "link", "md_inline", 1.0)],
        "src string, dst string, kind string, method string, confidence double")
    start = spark.createDataFrame([("a",)], "node string")

    def ask(hops):
        reached, used = gr.neighbours(edges, start, hops)
        return ({r[0] for r in reached.collect()},
                {(r["src"], r["dst"]) for r in used.collect()},
                gr.provenance(used).first()[0])

    assert ask(1) == ({"b"}, {("a", "b")}, "complete")
    assert ask(2) == ({"b", "c"}, {("a", "b"), ("b", "a"), ("b", "c")}, "partial")
    assert ask(4) == ({"b", "c", "d"}, {("a", "b"), ("b", "a"), ("b", "c"), ("c", "d")}, "partial")
    assert ask(0) == (set(), set(), "complete")


def test_bad_edges_are_found(spark):
    edges = spark.createDataFrame([("a", "b", "link", "", 1.0), ("a", "c", "link", "m", 1.5),
                                   ("a", "d", "link", "m", 0.5)],
                                  "src string, dst string, kind string, method string, confidence double")
    assert {r["dst"] for r in gr.check_edges(edges).collect()} == {"b", "c"}
