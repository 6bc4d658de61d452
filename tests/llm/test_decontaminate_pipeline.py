import os
import random

import numpy as np
from support import ODD, documents, text, words

import corpus_pipeline
from treegauge.llm import decontaminate as dc
from treegauge.llm.registry import ORACLES, QUERIES


def _tables(spark):
    items = [(i, text(9000 + i, 30 + i).capitalize() + ". " + text(9500 + i, 9).capitalize() + ".") for i in range(6)]
    rows = [(i, text(i, 150)) for i in range(150)]
    planted = []
    for k, (item_id, item) in enumerate(items[:4]):
        own = text(700 + k, 200).split()
        rows.append((700 + k, " ".join(own[:61 + 7 * k] + item.split() + own[61 + 7 * k:])))
        planted.append((700 + k, item_id))
    # A paraphrase: every fifth word of the question is another one, the answer is whole.
    question, answer = items[4][1].split(". ")
    changed = [w if i % 5 else "otherword%d" % i for i, w in enumerate(question.split())]
    rows.append((800, text(801, 70) + " " + " ".join(changed) + ". " + answer + " " + text(802, 70)))
    planted.append((800, items[4][0]))
    half = " ".join(items[5][1].split()[:12])
    rows.append((810, text(811, 70) + " " + half + " " + text(812, 70)))
    return rows, items + [(90, None), (91, ""), (92, "too short")], planted


def test_items_and_paraphrases_are_found_and_nothing_else(spark):
    rows, items, planted = _tables(spark)
    docs = documents(spark, rows + ODD + [rows[-3]])
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id bigint, text string, doc_id string")
    got = dc.contaminated(docs, bench).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == sorted(planted + [(rows[-3][0], planted[-2][1])])
    clean = dc.without_contaminated(docs, bench)
    assert clean.columns == docs.columns
    assert sorted(map(str, (r["doc_id"] for r in clean.collect()))) == sorted(
        str(i) for i, _ in rows + ODD if i not in {p[0] for p in planted})
    assert dc.contaminated(docs.limit(0), bench).collect() == []
    assert dc.contaminated(documents(spark, rows[:5]), bench.limit(0)).collect() == []


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    rows, items, planted = _tables(spark)
    monkeypatch.setattr(dc, "ITEM_BLOCK", 3)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in dc.contaminated(documents(spark, rows), bench).collect()) == sorted(planted)


def test_no_copies_of_the_latent_space_stay(spark):
    rows, items, planted = _tables(spark)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    docs = documents(spark, rows)
    own = spark.sparkContext._temp_dir
    before = set(os.listdir(own))
    clean = dc.without_contaminated(docs, bench)
    assert [n for n in set(os.listdir(own)) - before if os.path.getsize(os.path.join(own, n)) > 1 << 20] == []
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(i for i, _ in rows if i not in {p[0] for p in planted})


def test_hashes_and_common_subsequence():
    h, bounds = dc.hashed([b"The cat. THE  dog", b"", b"cat"])
    assert np.diff(bounds).tolist() == [4, 0, 1] and h[0] == h[2] and h[1] == h[4]
    rng = random.Random(8)
    for _ in range(30):
        a = [rng.randrange(6) for _ in range(rng.randint(5, 20))]
        b = [rng.randrange(6) for _ in range(rng.randint(0, 40))]
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        item = dc.Item(1, np.array(a, np.uint64), len(a) - 2, np.ones(len(a)))
        assert abs(item.shares(b)[0] - table[-1][-1] / len(a)) < 1e-12


def test_stages_keep_columns_and_clean_documents(spark, tmp_path):
    rows = [(i, text(i, 60)) for i in range(240)] + [(770, text(3, 60)), (771, 'see token = "%s" here' % ("ab12" * 10)), (772, None)]
    labels = [(i, 1, int(i % 6 == 0)) for i in range(240)]
    rows = [(i, t + " gruzzle wretchstone vilemoss" if i < 240 and i % 6 == 0 else t) for i, t in rows]
    bench = text(40, 60)
    folder = str(tmp_path)
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame([(i, t, "en", None, len(t or "")) for i, t in rows], schema).write.parquet(folder + "/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(folder + "/labels.parquet")
    spark.createDataFrame([(1, bench)], "item_id bigint, text string").write.parquet(folder + "/benchmark.parquet")
    docs = spark.read.parquet(folder + "/documents.parquet")
    ids = []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(folder + "/%d" % n)
        after = spark.read.parquet(folder + "/%d" % n)
        assert n == len(corpus_pipeline.STAGES) - 1 or after.columns == docs.columns
        ids.append({r["doc_id"] for r in after.select("doc_id").distinct().collect()})
        docs = after
    assert not any(i % 6 == 0 for i in ids[0] if i < 240) and {1, 2, 3, 770, 771, 772} <= ids[0]
    assert ids[1] == ids[0] - {770}
    assert ids[2] == ids[1] - {40} and ids[4] == ids[3] == ids[2]
    secret = spark.read.parquet(folder + "/3").filter("doc_id = 771").first()["text"]
    assert "ab12ab12" not in secret
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, folder).select("doc_id").distinct().collect()} == ids[4]


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)


def test_long_items_are_found_by_their_parts():
    space = np.random.default_rng(4).normal(size=(dc.BUCKETS, dc.LATENT)).astype(np.float32)
    rows, hosts, want = [], [], []
    for n in (150, 500, 700, 1000):
        item = ["item%dword%d" % (n, i) for i in range(n)]
        rows.append((n, " ".join(item)))
        changed = [w if i % 4 else "unseen%d" % i for i, w in enumerate(item)]
        for own in (item, changed):
            want.append((len(hosts), n))
            hosts.append(" ".join([text(n, 90), *own, text(n + 1, 90)]).encode())
    # A part of a long item is not the item.
    hosts.append(" ".join([text(1, 90), *rows[3][1].split()[200:400], text(2, 90)]).encode())
    items = dc.items_of(rows, np.ones(dc.BUCKETS))
    assert sorted(h[:2] for h in dc.Searcher(items, space).hits(hosts)) == want


def test_rare_foreign_words_do_not_hide_an_item():
    rows = [(i, " ".join("item%dword%d" % (i, k) for k in range(40))) for i in range(20)]
    counts = np.zeros(dc.BUCKETS + 1, np.int64)
    counts[dc.BUCKETS] = 10 ** 7
    for _, item in rows:
        counts[dc.buckets_of(dc.hashed([item.encode()])[0])] = 20_000
    hosts = [" ".join([text(i, 60), *[w if k % 4 else "unseen%d" % (i * k) for k, w in enumerate(item.split())],
                       text(i + 50, 60)]).encode() for i, item in rows]
    items = dc.items_of(rows, dc.weights_of(counts))
    directions = np.random.default_rng(4).normal(size=(dc.BUCKETS, dc.LATENT))

    def found(weights):
        space = (directions * weights[:, None]).astype(np.float32)
        return [h[:2] for h in dc.Searcher(items, space).hits(hosts)]
    assert sorted(found(dc.search_weights_of(counts))) == [(i, i) for i in range(20)]
    assert len(found(dc.weights_of(counts))) < 10


def _more_than_a_sample():
    rng = np.random.default_rng(3)
    vocabulary = words(77, 400)
    chances = 1 / np.arange(1, 401)
    return [" ".join(vocabulary[k] for k in rng.choice(400, n, p=chances / chances.sum()))
            for n in rng.integers(1, 12, 7000)] + [" ".join(vocabulary * 3), "same " * 40_000, "", None]


def _assert_fitted_on_all(space, counts, texts):
    """The same fit by dense matrices over the buckets that occur."""
    rows = dc.passages(*dc.hashed([(t or "").encode() for t in texts]))
    numbers = np.unique(rows[rows < dc.BUCKETS])
    words_in = np.stack([(rows == n).sum(1) for n in numbers], axis=1)
    assert counts[dc.BUCKETS] == len(rows)
    assert counts[numbers].tolist() == (words_in > 0).sum(0).tolist()
    weight = dc.search_weights_of(counts)
    share = words_in * weight[numbers]
    share /= np.sqrt((words_in * weight[numbers] ** 2).sum(1, keepdims=True))
    block = dc._orthogonal(np.random.default_rng(42).standard_normal(
        (dc.BUCKETS, dc.LATENT + dc.EXTRA), np.float32)).astype(np.float64)
    for _ in range(dc.POWER + 1):
        last, block = block, np.zeros_like(block)
        block[numbers] = share.T @ (share @ last[numbers])
        product, block = block, np.linalg.qr(block)[0]
    squares, turn = np.linalg.eigh(last.T @ product)
    want = last @ turn[:, np.argsort(-squares)[1:dc.LATENT + 1]]
    rest = np.random.default_rng(43).standard_normal(want.shape, np.float32)
    rest *= np.sqrt((1 - (want ** 2).sum(1)) / (rest ** 2).sum(1))[:, None]
    got = space / weight[:, None] - rest
    # Directions have no sign.
    assert np.abs(np.abs((got[numbers] * want[numbers]).sum(0)) - 1).max() < 0.01


def test_the_latent_space_is_fitted_on_the_passages_of_all_documents(spark):
    texts = _more_than_a_sample()
    kept = dc.kept_passages(documents(spark, list(enumerate(texts))).repartition(7))
    counts = dc.frequencies(kept)
    _assert_fitted_on_all(dc.latent_space(kept, counts), counts, texts)


def test_the_layout_of_the_rows_changes_no_cosine(spark):
    rows, items, planted = _tables(spark)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    docs = documents(spark, rows)
    some = [sorted((r["doc_id"], r["item_id"], r["cosine"]) for r in dc.contaminated(d, bench).collect())
            for d in (docs.coalesce(1), docs.repartition(3, "doc_id"), docs.repartition(7, "text"))]
    for other in some:
        assert [r[:2] for r in other] == sorted(planted)
        assert max(abs(a[2] - b[2]) for a, b in zip(some[0], other, strict=True)) < 1e-4


def test_the_stage_fits_on_all_of_its_documents(spark, tmp_path, monkeypatch):
    texts = _more_than_a_sample()
    given = {}
    for name in ("frequencies", "latent_space"):
        def keeping(*args, name=name, real=getattr(dc, name)):
            given[name] = real(*args)
            return given[name]
        monkeypatch.setattr(dc, name, keeping)
    spark.createDataFrame([(1, text(40, 30))], "item_id bigint, text string").write.parquet(
        str(tmp_path) + "/benchmark.parquet")
    docs = documents(spark, list(enumerate(texts)))
    assert corpus_pipeline.without_benchmark(spark, docs, str(tmp_path)).count() == len(texts)
    _assert_fitted_on_all(given["latent_space"], given["frequencies"], texts)


def test_products_of_passages_are_those_of_dense_matrices():
    rng = np.random.default_rng(6)
    for chosen in (40, 3000, dc.BUCKETS):
        sizes = rng.integers(1, dc.PASSAGE + 1, 3000).astype(np.uint8)
        buckets = (rng.zipf(1.3, int(sizes.sum())) % chosen).astype(np.uint16)
        weight, block = rng.random(dc.BUCKETS, np.float32), rng.standard_normal((dc.BUCKETS, 5), np.float32)
        total = np.ones((dc.BUCKETS, 5), np.float32)
        dc.add_products(total, buckets, sizes, weight, block)
        met, place = np.unique(buckets, return_inverse=True)
        share = np.zeros((len(sizes), len(met)))
        passage = np.repeat(np.arange(len(sizes)), sizes)
        np.add.at(share, (passage, place), weight[buckets])
        share /= np.sqrt(np.bincount(passage, weight[buckets].astype(np.float64) ** 2))[:, None]
        want = np.ones((dc.BUCKETS, 5))
        want[met] += share.T @ (share @ block[met])
        assert np.abs(total - want).max() < 1e-4 * np.abs(want).max()


def test_hashes_of_words_of_any_length():
    rng = random.Random(4)
    texts = [b"", *(bytes(rng.choice(b"abZ09 \xc3\xa9.") for _ in range(rng.randrange(300))) for _ in range(50)),
             b" ".join(b"w" * n for n in (1, 31, 32, 33, 64, 65, 127, 128, 300))]
    got, bounds = dc.hashed(texts)
    want = []
    for t in texts:
        folded = bytes(dc._FOLD[np.frombuffer(t, np.uint8)])
        for w in folded.replace(b"\0", b" ").split(b" "):
            if w:
                h = sum((c + 1) * int(dc._POWERS[i & 63]) for i, c in enumerate(w)) % (1 << 64)
                want.append((h ^ h >> 29) * 0xBF58476D1CE4E5B9 % (1 << 64))
    assert got.tolist() == want and bounds[-1] == len(want) and len(bounds) == len(texts) + 1
