import numpy as np
import pytest
from pyspark.sql import functions as F

from treegauge import Refused
from treegauge.functions import text as X
from treegauge.functions.vectors import mulberry32
from treegauge.operators import embed


def _chunks(text):
    if "\0" in text[:8192]:
        return []
    out, start = [], 0
    while True:
        piece = text[start:start + 1000].strip()
        if piece:
            out.append(piece)
        if start + 1000 >= len(text):
            return out
        start += 900


def test_chunks_agree_with_a_plain_loop(spark):
    texts = ["", "x", "x" * 1000, "x" * 1001, "x" * 1900, "x" * 1901, "x" * 2500, " \n\t ", "a\0b",
             "y" * 950 + " " * 2000 + "z", " edge ", "ab " * 900, "x" * ((1 << 20) + 5000)]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "i string, t string")
    for r in df.select("i", X.chunk_pieces("t").alias("c")).collect():
        assert r["c"] == _chunks(texts[int(r["i"])]), r["i"]


def test_copies_are_chunked_once(spark, rows):
    df = spark.createDataFrame([("a", "s", "one"), ("b", "s", "one"), ("c", "t", " "), ("d", None, None)],
                               "path string, sha256 string, text string")
    assert rows(embed.chunks(df)) == [("s", 0, "one")]
    assert rows(embed.chunk_keys(df)) == [("s", 0)]


def test_maintenance_and_incremental_update(spark, rows):
    content = spark.createDataFrame([("a", "s", "word " * 300), ("b", "t", "new")],
                                    "path string, sha256 string, text string")
    model = embed.hashing_model(8)
    have = spark.createDataFrame([("s", 0, [9.0] * 8), ("old", 0, [1.0] * 8)], embed.VECTORS)
    actions = embed.maintenance(embed.chunk_keys(content), have)
    assert rows(actions) == [("old", 0, "drop"), ("s", 0, "keep"), ("s", 1, "embed"), ("t", 0, "embed")]
    assert tuple(embed.maintenance_tally(actions).first()) == (2, 1, 1, 3)
    assert tuple(embed.coverage(embed.chunk_keys(content), have).first()) == (1, 3)
    new = {(r["sha256"], r["ord"]): r["vector"]
           for r in embed.update_vectors(content, have, model, 8).collect()}
    assert set(new) == {("s", 0), ("s", 1), ("t", 0)} and new[("s", 0)] == [9.0] * 8
    redone = {(r["sha256"], r["ord"]): r["vector"]
              for r in embed.update_vectors(content, have, model, 8, False).collect()}
    assert set(redone) == set(new) and redone[("s", 0)] != [9.0] * 8
    moved = embed.maintenance(embed.chunk_keys(content), have, False)
    assert tuple(embed.maintenance_tally(moved).first()) == (3, 0, 2, 3)


def test_another_model_is_refused():
    embed.check_model({}, "m", 8)
    with pytest.raises(Refused):
        embed.check_model({"embed_model": "other"}, "m", 8)
    with pytest.raises(Refused):
        embed.check_model({"embed_model": "m", "embed_dim": "9"}, "m", 8)


@pytest.fixture(scope="module")
def space(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(200, 6)).astype("f4")
    vectors[7] = 0
    keys = [("s%03d" % (i // 2), i % 2) for i in range(200)]
    df = spark.createDataFrame([(s, o, [float(x) for x in v]) for (s, o), v in zip(keys, vectors)],
                               embed.VECTORS).repartition(5)
    return keys, vectors.astype("f8"), df


def _scores(keys, vectors, query):
    query = np.asarray(query, dtype="f8")
    norms = np.linalg.norm(vectors, axis=1) * np.linalg.norm(query)
    scores = np.divide(vectors @ query, norms, out=np.zeros(len(vectors)), where=norms > 0)
    best = {}
    for (sha, ord_), score in zip(keys, scores):
        if sha not in best or score > best[sha][0]:
            best[sha] = (score, ord_)
    return best


def test_search_agrees_with_brute_force(spark, space):
    keys, vectors, df = space
    content = spark.createDataFrame([("/p/%s/%d" % (s, c), s) for s in sorted({k for k, _o in keys})
                                     for c in range(2)], "path string, sha256 string")
    best = _scores(keys, vectors, vectors[11])
    want = sorted(((-sc, "/p/%s/%d" % (s, c), o) for s, (sc, o) in best.items() for c in range(2)))[:10]
    got = embed.search(df, content, [float(x) for x in vectors[11]]).collect()
    assert [(r["path"], r["ord"]) for r in got] == [(p, o) for _s, p, o in want]
    assert embed.check_dim(df, 6).count() == 0 and embed.check_dim(df, 7).count() == 200


def test_many_queries_keep_every_best_content(spark, space, monkeypatch):
    keys, vectors, df = space
    monkeypatch.setattr(embed, "QUERY_BLOCK_BYTES", 100)  # several blocks
    asked = spark.createDataFrame([(q, [float(x) for x in vectors[q]]) for q in range(5)],
                                  "qid bigint, vector array<float>")
    got = {}
    for r in embed.search_many(df, asked, depth=5).collect():
        got.setdefault(r["qid"], {})[r["sha256"]] = r["score"]
    for q in range(5):
        best = sorted(((-s, sha) for sha, (s, _o) in _scores(keys, vectors, vectors[q]).items()))[:5]
        for score, sha in best:
            assert abs(got[q][sha] + score) < 1e-6


def test_counter_generator_agrees_with_the_sequential_one(spark):
    def sequence(seed, n):
        out, mask = [], 0xFFFFFFFF
        for _ in range(n):
            seed = (seed + 0x6D2B79F5) & mask
            t = ((seed ^ (seed >> 15)) * (1 | seed)) & mask
            t = ((t + (((t ^ (t >> 7)) * (61 | t)) & mask)) & mask) ^ t
            out.append(((t ^ (t >> 14)) & mask) / 4294967296)
        return out
    got = [r[0] for r in spark.range(1, 101).orderBy("id").select(mulberry32(F.col("id"), 1337)).collect()]
    assert got == sequence(1337, 100)
