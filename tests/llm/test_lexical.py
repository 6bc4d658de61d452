"""Ranked lexical search against its formula over all documents."""

import math
import random
import re

import numpy as np
import pytest
from support import ODD, documents, text, words

from treegauge.llm import lexical as L

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(t):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def by_formula(docs, items, depth=10):
    told = [(i, terms(t)) for i, t in docs]
    n_docs = sum(bool(ws) for _, ws in told)
    n_terms = sum(len(ws) for _, ws in told)
    df = {}
    for _, ws in told:
        for w in set(ws):
            df[w] = df.get(w, 0) + 1
    out = []
    for item_id, t in sorted(set(items), key=repr):
        hits = []
        for i, ws in told:
            score = 0
            for w in set(terms(t)) & set(ws):
                weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1)))
                m = 100 - 90 + (90 * len(ws) * n_docs) // n_terms
                score += weight * ((1000000000 * ws.count(w)) // (1000 * ws.count(w) + 8 * m))
            if score > 0:
                hits.append((-score, i is None, i))
        out += [(item_id, k + 1, i, -s) for k, (s, _, i) in enumerate(
            sorted(hits, key=lambda h: (h[0], h[1], h[2] or 0))[:depth])]
    return sorted(out, key=repr)


def corpus(n=400):
    rng = random.Random(8)
    stock = words(3, 300)
    out = [(i, " ".join(rng.choices(stock[:1 + i % 300], k=rng.randint(1, 60)))) for i in range(n)]
    return out + [(1000 + i, out[7][1]) for i in range(30)] + ODD


ITEMS = [(1, text(5)), (2, None), (3, ""), (4, "?!"), (5, "THE quick-Brown fox fox"), (6, "nowhere at all"),
         (6, "word"), (6, "word"), (None, "lorem word")]


def items_of(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "item_id bigint, text string, rank string")


@pytest.mark.parametrize("held, step, block", [(L.HELD, L.STEP, L.BLOCK_BYTES), (40, 3, 100)])
def test_like_the_formula(spark, rows, monkeypatch, held, step, block):
    """Also in many shards, in small steps and with several passes."""
    for name, value in (("HELD", held), ("STEP", step), ("BLOCK_BYTES", block)):
        monkeypatch.setattr(L, name, value)
    stock = words(3, 300)
    items = ITEMS + [(10 + k, " ".join(random.Random(k).sample(stock, 12))) for k in range(20)]
    docs = corpus()
    found = L.ranked(documents(spark, docs).repartition(3), items_of(spark, items))
    assert rows(found, "item_id", "rank", "doc_id", "score") == by_formula(docs, items)


def test_the_query(spark, rows, tmp_path):
    documents(spark, ODD).write.parquet(str(tmp_path / "documents.parquet"))
    items_of(spark, ITEMS).write.parquet(str(tmp_path / "benchmark.parquet"))
    found = L.op13_lexical(spark, str(tmp_path))
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert rows(found) == by_formula(ODD, ITEMS)


def test_no_rows(spark, rows):
    docs, items = documents(spark, ODD), items_of(spark, ITEMS)
    assert rows(L.ranked(docs.limit(0), items)) == []
    assert rows(L.ranked(docs, items.limit(0))) == []


def test_short_lists_and_skipping():
    """Both kinds of lists take part, ties go to the lesser id, and most documents are never looked at."""
    rng = np.random.default_rng(2)
    docs, seen, all_of = 5000, 0, 0
    for _ in range(30):
        lists = []
        for share in (0.8, 0.5, 0.3, 0.01, 0.002):
            d = np.flatnonzero(rng.random(docs) < share)
            lists.append((d, rng.integers(1, 20 if share > 0.1 else 400, len(d))))
        total = np.zeros(docs, np.int64)
        for d, v in lists:
            total[d] += v
        ids = rng.permutation(docs)
        counted = {}
        found, score = L.best(lists, docs, 10, ids, 0, counted)
        want = np.lexsort((ids, -total))[:10]
        assert found.tolist() == want.tolist() and score.tolist() == total[want].tolist()
        seen += counted["seen"]
        all_of += docs
    assert seen < all_of / 3


def test_nothing_to_find():
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    ids = np.arange(5)
    assert [len(x) for x in L.best([], 5, 10, ids)] == [0, 0]
    assert [len(x) for x in L.best([none], 5, 10, ids)] == [0, 0]
