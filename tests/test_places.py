"""Terms and their places, for all rows at once, against plain Python."""

import random

import pyarrow as pa
import pytest

from treegauge.functions import places as pl
from treegauge.operators import evaluate as ev, search as se


def _form(words):
    return "  ".join(["", *words, ""]) if words else "  "


def test_places_of_every_term():
    rng = random.Random(3)
    rows = [([rng.choice("abcdeé") for _ in range(rng.randrange(9))], [rng.choice("abf") for _ in range(rng.randrange(4))])
            for _ in range(40)] + [([], []), ([], ["z"]), (["y"], [])]
    t, s = (pa.array([_form(r[k]) for r in rows]) for k in range(2))
    for only in (None, pa.array(["a", "z", "nowhere"])):
        terms, code, row, in_text, in_symbols = pl.places(t, s, only)
        got = {(terms[c].as_py(), r): (a, b) for c, r, a, b in zip(
            code.tolist(), row.tolist(), in_text.to_pylist(), in_symbols.to_pylist(), strict=True)}
        want = {(w, r): ([i for i, x in enumerate(a) if x == w], [i for i, x in enumerate(b) if x == w])
                for r, (a, b) in enumerate(rows) for w in set(a + b) if only is None or w in only.to_pylist()}
        assert got == want and len(code) == len(want)


def test_stretches_hold_every_row_once(monkeypatch):
    monkeypatch.setattr(pl, "STRETCH", 10)
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * n for n in (0, 3, 25, 0, 9, 1)])], ["t"])
    parts = pl.stretches(batch, "t")
    assert [v for p in parts for v in p.column(0).to_pylist()] == batch.column(0).to_pylist() and len(parts) > 2
    assert pl.stretches(batch.slice(0, 0), "t") == []


def test_term_stats_count_documents_and_uses(spark, rows):
    content = spark.createDataFrame([("/a", "x y x fooBar"), ("/b", "Y"), ("/c", None), ("/d", "")], "path string, text string")
    want = [("bar", 1, 1), ("foo", 1, 1), ("foobar", 1, 1), ("x", 1, 2), ("y", 2, 2)]
    assert rows(se.term_stats(content)) == want
    # A path that comes twice is one document.
    assert rows(se.term_stats(content.unionByName(content.filter("path = '/b'")))) == want[:-1] + [("y", 2, 3)]


def test_frequent_words_are_not_sent_to_one_task(spark, rows):
    """Rows that are shuffled do not grow with the documents that hold an asked word."""
    content = spark.range(3000).selectExpr("concat('/', id) AS path", "'fooBar see foo bar' AS text")
    asked = spark.createDataFrame([("case", "foo bar", 1)], "cause string, query string, n bigint")
    assert se.term_sets(content, ["bar", "foo"]).count() == 1
    assert rows(ev.splitting_recall(content, asked)) == [("case", 1, 1, 1)]


def test_many_hits_and_ties(spark):
    """Without a depth every hit has its place, and equal parts tie whatever their order."""
    docs = [("/%03d" % i, "alpha beta " + ("alpha " * 3 + "beta " * 2 if i % 2 else "beta " * 3 + "alpha " * 2) + "gamma")
            for i in range(80)] + [("/z%d" % i, "delta") for i in range(200)]
    content = spark.createDataFrame(docs, "path string, text string")
    asked = spark.createDataFrame([(1, "alpha beta gamma")], "qid int, query string")
    got = se.search_many(content, asked, None).orderBy("position").collect()
    assert [r["path"] for r in got] == [p for p, _ in docs[:80]] and [r["position"] for r in got] == list(range(1, 81))
    assert len({r["rank"] for r in got}) == 1


def test_asked_terms_in_blocks(spark, monkeypatch, rows):
    monkeypatch.setattr(se, "ASKED", 1)
    content = spark.createDataFrame([("/a", "x y x"), ("/b", "z")], "path string, text string")
    terms = spark.createDataFrame([("x",), ("y",), ("x",)], "term string")
    assert rows(se.asked_positions(content, terms)) == [
        ("", "/a", [], [], 3), ("", "/b", [], [], 1), ("x", "/a", [0, 2], [], 3), ("y", "/a", [1], [], 3)]


@pytest.mark.parametrize("text, words", [("plain Plain éaB x9 a.b _a foo. HTTPServer", ["aB", "x9", "a.b", "HTTPServer"]),
                                         ("", []), ("Ab ab", []), ("/x/y ab__ Ab.c", ["/x/y", "Ab.c"])])
def test_words_that_come_apart(spark, text, words):
    from treegauge.functions import text as X

    assert spark.createDataFrame([(text,)], "text string").select(X.splittable_words("text")).first()[0] == words
