"""Cross-parsing against its definition, and language identification of unseen texts."""

import random
import zlib

import numpy as np
import pytest
from support import ODD, documents

from treegauge.llm import language_id as L

PARTS = {"aa": ["ka", "lo", "mi", "ter"], "bb": ["sch", "ung", "ein", "ü"], "cc": ["eau", "oi", "qu", "é"]}


def prose(lang, seed, n=60):
    rng = random.Random("%s %s" % (lang, seed))
    return " ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def phrases_by_definition(text, known):
    """Greedy: each phrase is the longest that stands in `known`, at least a byte."""
    at = n = 0
    while at < len(text):
        stop = at + 1
        while stop < len(text) and text[at:stop + 1] in known:
            stop += 1
        at, n = stop, n + 1
    return n


def test_phrases_like_the_definition():
    rng = random.Random(3)
    for _ in range(20):
        known = [bytes(rng.choice(b"abc ") for _ in range(rng.randint(1, 80))) for _ in range(3)]
        read = L.Parser(L.Model(("x", "y", "z"), tuple(known)))
        sections = [bytes(rng.choice(b"abcd ") for _ in range(rng.randint(0, 50))) for _ in range(9)]
        want = [[phrases_by_definition(s, k) for k in known] for s in sections]
        assert read.phrases(sections).tolist() == want


def test_automaton_reads_substrings_only():
    text = b"abcbcabbac"
    step = L.suffix_automaton(text)
    rng = random.Random(5)
    for _ in range(500):
        word = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 6)))
        state = 0
        for c in word:
            state = step[state].get(c)
            if state is None:
                break
        assert (state is not None) == (word in text)


def test_long_texts_are_cut_whole():
    for text in (b" ", b" ab ", (b" word" * 3000) + b" ", b"x" * 9000):
        assert b"".join(L.cut(text)) == text
        assert max(map(len, L.cut(text))) <= 2 * L.SECTION


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, prose(lang, i), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 60)]
    rows += [(500, None, "aa"), (501, "", "bb"), (502, "123 !!", "cc"), (503, prose("aa", 503), None),
             (None, prose("bb", 9), "bb"), (None, prose("bb", 9), "bb"), (504, prose("cc", 1, 9000), "cc")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string")


def test_the_query(spark, corpus, tmp_path):
    corpus.write.parquet(str(tmp_path / "documents.parquet"))
    found = L.op11_language_id(spark, str(tmp_path))
    assert found.columns == ["doc_id", "held_out", "lang_pred", "score"]
    got = found.collect()
    assert len(got) == corpus.count()
    for r in got:
        rest = None if r["doc_id"] is None else zlib.crc32(str(r["doc_id"]).encode()) % 3
        assert r["held_out"] == (rest == 1) and 0.0 <= r["score"] <= 1.0
    want = {r["doc_id"]: r["lang"] for r in corpus.collect() if r["doc_id"] is not None and r["doc_id"] < 500}
    assert all(r["lang_pred"] == want[r["doc_id"]] for r in got if r["doc_id"] in want)
    said = {r["doc_id"]: r["lang_pred"] for r in got}
    assert [said[i] for i in (500, 501, 502, 503, 504)] == ["und", "und", "und", "aa", "cc"]
    assert said[None] == "bb"


def test_only_rows_that_are_not_held_out_teach(spark):
    """A language that held-out rows alone have is never learnt."""
    out = [i for i in range(200) if zlib.crc32(str(i).encode()) % 3 == 1]
    rows = [(i, prose("cc" if i in out else "aa", i), "cc" if i in out else "aa") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    from pyspark.sql import functions as F
    assert L.learn(docs.where(~L.held_out(F.col("doc_id")))).langs == ("aa",)


def test_copies_and_bounds(spark, monkeypatch):
    """A text of which there are many copies teaches once; the bound holds."""
    rows = [(i, prose("aa", 1), "aa") for i in range(300)] + [(i, prose("aa", i), "aa") for i in range(300, 400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    whole = L.learn(docs).texts[0]
    assert whole.count(L.normalised(prose("aa", 1))[8:60]) <= 1
    monkeypatch.setattr(L, "OWN_BYTES", 1024)
    assert len(L.learn(docs).texts[0]) <= 1024
    assert L.learn(docs) == L.learn(docs.repartition(7))


def test_nothing_learnt_and_nothing_given(spark, rows):
    docs = documents(spark, ODD)
    none = L.learn(docs.limit(0))
    assert none.langs == ()
    assert {r[1] for r in rows(L.identified(docs, none))} == {"und"}
    assert rows(L.identified(docs.limit(0), L.Model(("a",), (b"abc",)))) == []


def test_entropy_grows_with_strangeness():
    read = L.Parser(L.Model(("aa", "bb"), tuple(L.normalised(prose(x, 1, 900)) for x in ("aa", "bb"))))
    bits = read.entropies([L.normalised(prose("aa", 2)), L.normalised(prose("bb", 2))])
    assert np.argmin(bits, axis=1).tolist() == [0, 1]
