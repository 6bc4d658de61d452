import random

import pytest
from pyspark.sql import functions as F

from test_search import DOCS, QUERIES
from treegauge.operators import blockindex as bi, evaluate as ev, search as se


@pytest.fixture(scope="module")
def many(spark):
    rng = random.Random(4)
    stock = ["w%d" % i for i in range(200)]
    rows = [("/m/%04d.md" % i, " ".join(rng.choices(stock[:10 + i % 190], k=rng.randint(1, 80)))) for i in range(1500)]
    rows += [("/copy/%03d.md" % i, "w1 w2 w3") for i in range(70)] + [("/none.md", None), ("/empty.md", "")]
    return spark.createDataFrame(rows, "path string, text string").cache()


@pytest.fixture(scope="module")
def small_ranges():
    held = bi.RANGE, bi.FIRST
    bi.RANGE, bi.FIRST = 16, 2
    yield
    bi.RANGE, bi.FIRST = held


@pytest.fixture(scope="module")
def written(spark, many, small_ranges, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("index"))
    bi.write(many, folder, 3)
    return bi.Index(spark, folder)


@pytest.mark.parametrize("raw", ["w1", "w3 w7", "w9 w9 w4", "w5 w1-w2", "w1 absent", ""])
def test_rows_of_the_scan(many, written, raw):
    got = [tuple(r) for r in written.search(raw).collect()]
    want = [tuple(r) for r in se.search(many, raw).collect()]
    assert [(p, w) for p, _, w in got] == [(p, w) for p, _, w in want]
    assert all(abs(a[1] - b[1]) < 1e-12 for a, b in zip(got, want))


def test_rows_of_the_scan_with_symbols_and_accents(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "path string, text string")
    bi.write(docs, str(tmp_path / "i"))
    index = bi.Index(spark, str(tmp_path / "i"))
    for raw in QUERIES:
        got = [(r["path"], r["place"], round(r["rank"], 9)) for r in index.search(raw).collect()]
        want = [(r["path"], r["place"], round(r["rank"], 9)) for r in se.search(docs, raw).collect()]
        assert got == want, raw


def test_blocks_are_skipped(written):
    """A word that is everywhere: a large part of its blocks is left out, none for an absent word."""
    read, of_all = written.blocks_read("w1", 5)
    assert 0 < read < 0.6 * of_all
    read, of_all = written.blocks_read("w3 w7", 5)
    assert 0 < read < of_all
    assert written.blocks_read("w3 absent", 5)[0] == 0


def test_bounds_hold(written):
    """No document of a block has more of its term, or is shorter, than the block says."""
    rows = written.blocks.filter("term <> ''").select("max_tf", "min_dl", "n", "dl", "t", "s").collect()
    for r in rows:
        assert r["max_tf"] == max(len(t) + len(s) for t, s in zip(r["t"], r["s"]))
        assert r["min_dl"] == min(r["dl"]) and r["n"] == len(r["dl"])


def test_no_scan_reads_text_and_the_term_is_pushed(written, capsys):
    written.search("w3 w7").explain("formatted")
    plan = capsys.readouterr().out
    written.blocks.filter(F.col("term").isin(["w3", "w7"])).select("n").explain("formatted")
    assert "In(term, [w3,w7])" in capsys.readouterr().out
    assert "text:string" not in plan


def test_nothing_indexed(spark, many, tmp_path):
    bi.write(many.limit(0), str(tmp_path / "i"))
    assert bi.Index(spark, str(tmp_path / "i")).search("w1").collect() == []


# -- questions and their targets ---------------------------------------------------

def _questions(spark, rows):
    return spark.createDataFrame(rows, "qid bigint, class string, query string")


def test_targets_hold_the_whole_question(spark, rows):
    words = ["v%d" % i for i in range(40)]
    text = " ".join(words)
    docs = [("/a", text), ("/b", "x" + text + "y"), ("/c", text.upper()), ("/d", " ".join(words[::-1])), ("/e", None),
            ("/f", "v3 v4 v5 v6 v7"), ("/g", "")]
    asked = [" ".join(words[5:20]), "v3 v4 v5 v6 v7", "v3 v4 v5", "4 v5", "v39", "no such words in any of these",
             text, "v3  v4 v5"]
    got = ev.holders(_questions(spark, list(zip(range(9), "A" * 9, asked))),
                     spark.createDataFrame(docs, "path string, text string"))
    assert rows(got) == sorted([(q, p) for q, a in enumerate(asked) for p, t in docs if t and a in t], key=repr)


def test_a_broken_set_is_refused(spark):
    from treegauge import Refused

    pairs = _questions(spark, [(1, "A", "one"), (2, "Z", "one")])
    gold = spark.createDataFrame([(1, "/x")], "qid bigint, target string")
    none = spark.createDataFrame([], "qid bigint, path string, rank double")
    ranked = spark.createDataFrame([], "layer string, qid bigint, path string, position int")
    with pytest.raises(Refused) as told:
        ev.scored(pairs, gold, gold.select(F.col("target").alias("path")), none, ranked)
    assert "unknown class (1, first 2)" in str(told.value) and "absolute target" in str(told.value)


def test_a_sound_set_is_scored(spark):
    rows_ = [(i, c, "q%d" % i) for i, c in enumerate(["A", "B", "C"] * 20)]
    pairs = _questions(spark, rows_)
    gold = spark.createDataFrame([(i, "t/%d" % i) for i, _, _ in rows_], "qid bigint, target string")
    lexical = spark.createDataFrame([(i, "t/%d" % i, -1.0) for i, c, _ in rows_ if c == "B"],
                                    "qid bigint, path string, rank double")
    ranked = lexical.selectExpr("'lexical' AS layer", "qid", "path", "1 AS position")
    got = ev.scored(pairs, gold, gold.selectExpr("target AS path"), lexical, ranked).collect()
    assert {r["class"]: (r["lexical_hits"], r["total"]) for r in got} == {"A": (0, 20), "B": (20, 20), "C": (0, 20)}
