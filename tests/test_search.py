import sqlite3

import pytest
from pyspark.sql import functions as F

from treegauge.functions import text as X
from treegauge.operators import search as se

DOCS = [
    ("/c/plain.md", "the write barrier refuses a second writer, the barrier of the store"),
    ("/c/handlers.py", "def getUserById(user_id): return HTTPServer.utf8Decode(user_id)"),
    ("/c/shapes.py", "snake_case_name kebab-case-name dotted.path.here of the of the"),
    ("/c/ranked.md", "barrier barrier barrier writer"),
    ("/c/accent.md", "Éclair über naïve café ØRSTED straße étude"),
    ("/c/empty.md", ""),
    ("/c/long.md", "filler words " * 40 + "barrier of the end"),
]
QUERIES = ["barrier", "barrier writer", "the", "getUserById", "user by id", "of-the", "snake_case_name",
           "eclair", "Café", "foo AND (bar", "*", '"unbalanced', "NEAR(a b)", "barrier of the",
           "http server", "of-the-of", "orsted", "ørsted", "case name", "second second", "etude"]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(DOCS, "path string, text string").cache()


@pytest.fixture(scope="module")
def fts(corpus):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(path UNINDEXED, text, symbols,"
               " tokenize='unicode61 remove_diacritics 2')")
    symbols = {r["path"]: r["s"] for r in corpus.select("path", X.symbols("text").alias("s")).collect()}
    db.executemany("INSERT INTO t VALUES (?, ?, ?)", [(p, t, symbols[p]) for p, t in DOCS])
    return db


def _match(raw):
    return " ".join('"%s"' % " ".join(p) for p in X.query_phrases(raw))


def _expected(db, raw):
    query = _match(raw)
    if not query:
        return []
    hits = db.execute("SELECT path, bm25(t), rowid FROM t WHERE t MATCH ? ORDER BY bm25(t), path LIMIT 20",
                      (query,)).fetchall()
    text = {r for (r,) in db.execute("SELECT rowid FROM t WHERE t MATCH ?", ("text : (%s)" % query,))}
    return [(p, rank, "text" if row in text else "symbols") for p, rank, row in hits]


@pytest.mark.parametrize("raw", QUERIES)
def test_scan_agrees_with_a_full_text_table(corpus, fts, raw):
    got = [tuple(r) for r in se.search(corpus, raw).collect()]
    want = _expected(fts, raw)
    assert [(p, w) for p, _r, w in got] == [(p, w) for p, _r, w in want]
    assert all(abs(a[1] - b[1]) < 1e-9 for a, b in zip(got, want))


def test_index_and_tables_of_queries_agree_with_the_scan(spark, corpus, tmp_path):
    se.write_index(corpus, str(tmp_path))
    index = spark.read.parquet(str(tmp_path / "postings"))
    lengths = spark.read.parquet(str(tmp_path / "lengths"))
    asked = spark.createDataFrame(list(enumerate(QUERIES)), "qid bigint, query string")
    many = {}
    for r in se.search_many(corpus, asked, 20).orderBy("qid", "position").collect():
        many.setdefault(r["qid"], []).append((r["path"], round(r["rank"], 9)))
    for qid, raw in enumerate(QUERIES):
        scan = [(r["path"], round(r["rank"], 9)) for r in se.search(corpus, raw).collect()]
        if raw in ("barrier writer", "of-the", "user by id", "*", "of-the-of"):
            index_hits = se.search_index(index, lengths, raw).collect()
            assert [(r["path"], round(r["rank"], 9)) for r in index_hits] == scan, raw
        assert many.get(qid, []) == scan, raw


def test_repeated_words_of_a_query_count(spark):
    content = spark.createDataFrame([("a", "foo bar"), ("b", "foo foo foo bar"), ("c", "bar bar foo"),
                                     ("d", "none"), ("e", "none"), ("f", "none"), ("g", "none")],
                                    "path string, text string")
    asked = spark.createDataFrame([(1, "foo foo bar"), (2, "foo bar")], "qid bigint, query string")
    many = {(r["qid"], r["path"]): r["rank"] for r in se.search_many(content, asked).collect()}
    for qid, raw in ((1, "foo foo bar"), (2, "foo bar")):
        scan = {(qid, r["path"]): r["rank"] for r in se.search(content, raw).collect()}
        assert scan and all(abs(many[k] - v) < 1e-9 for k, v in scan.items())
    assert many[1, "a"] < many[2, "a"]


def test_split_identifiers(spark):
    cases = {"getUserById": "get user by id", "snake_case_name": "snake case name",
             "kebab-case-name": "kebab case name", "dotted.path.here": "dotted path here",
             "HTTPServer": "http server", "utf8Decode": "utf 8 decode", "plain": "plain",
             "A1b2C": "a 1 b 2 c", "__x__": "x"}
    df = spark.createDataFrame(list(cases.items()), "w string, want string").withColumn(
        "got", F.array_join(X.split_identifier("w"), " "))
    assert all(r["got"] == r["want"] for r in df.collect())


def test_symbols_hold_only_words_that_split(spark):
    df = spark.createDataFrame([("plain words only",), ("see getUser and getUser in a.b /x/y",)],
                               "t string").select(X.symbols("t"))
    assert [r[0] for r in df.collect()] == ["", "a b get user x y"]


def test_index_state_tells_missing_from_stale_from_ok(spark):
    content = spark.createDataFrame([("a", "x"), ("b", None)], "path string, text string")
    one = content.filter("path = 'a'").select("path")
    assert tuple(se.index_state(content, None).first()) == ("missing", 0, 1)
    assert tuple(se.index_state(content, one).first()) == ("ok", 1, 1)
    assert tuple(se.index_state(content, content.select("path")).first()) == ("stale", 2, 1)
