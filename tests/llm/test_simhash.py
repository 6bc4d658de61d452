import random

import numpy as np
from support import ODD, documents, words
from xxhash import xxh64_intdigest

from treegauge.llm import simhash as sh
from treegauge.llm.components import components


def _fingerprint(text, width):
    own = (text or "").encode().translate(sh._LOWER).split()
    if not own:
        return 0
    hashes = [xxh64_intdigest(b" ".join(own[i:i + width]), 42) for i in range(max(1, len(own) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _roots(fps, distance):
    roots = {f: f for f in fps}

    def find(x):
        while roots[x] != x:
            x = roots[x]
        return x
    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= distance:
                roots[find(a)] = find(b)
    return {f: find(f) for f in fps}


def test_components_of_odd_rows(spark):
    rows = ODD + [(20, ODD[0][1]), (21, ODD[0][1].upper()), (22, None), (23, "a b"), (24, "A  B")]
    got = sh.near_duplicates(documents(spark, rows), 3, 2).collect()
    assert len(got) == len(rows)
    want = {(i, t): _fingerprint(t, 3) for i, t in rows}
    roots = _roots(set(want.values()), 2)
    least = {}
    for (i, _), f in want.items():
        if i is not None:
            least[roots[f]] = min(least.get(roots[f], i), i)
    expected = sorted((str(i), sh.signed(want[i, t]), least.get(roots[want[i, t]])) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["fp"], r["component_id"]) for r in got) == expected
    assert sh.near_duplicates(documents(spark, []), 3, 2).collect() == []


def test_links_connect_as_all_pairs_do_whatever_the_crowd(spark):
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for f in list(fps)[:30]:
        for _ in range(4):
            f ^= 1 << rng.randrange(64)
            fps.add(f)
    frame = spark.createDataFrame([(sh.signed(f),) for f in fps], "fp bigint").repartition(3)
    for distance, crowd in ((2, 64), (2, 1), (1, 2), (3, 64)):
        links = sh.links(frame, distance, crowd)
        pairs = links.collect()
        assert all(((r["a"] ^ r["b"]) & (1 << 64) - 1).bit_count() <= distance for r in pairs)
        parts = {}
        for r in components(links).collect():
            parts.setdefault(r["root"], set()).add(r["node"])
        want = {}
        for f, root in _roots(fps, distance).items():
            want.setdefault(root, set()).add(sh.signed(f))
        assert sorted(map(sorted, parts.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_a_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(5, 5), (7, 6)], "a bigint, b bigint")
    assert {tuple(r) for r in components(edges).collect()} == {(i, 0) for i in range(201)}
    assert components(edges.limit(0)).collect() == []


def test_embedding_and_manhattan(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(-2 ** 63, 2 ** 63 - 1, (50, 2))] + [(-1, 0), (0, 0)]
    frame = spark.createDataFrame(pairs, "x bigint, y bigint")
    got = frame.select(sh.manhattan(sh.embedding(frame.x), sh.embedding(frame.y)).alias("d")).collect()

    def counts(v):
        return [(v >> 2 * i & 3).bit_count() for i in range(32)]
    assert [r["d"] for r in got] == [sum(abs(a - b) for a, b in zip(counts(x), counts(y))) for x, y in pairs]


def test_one_of_each_group_stays_with_its_columns(spark):
    same = " ".join(words(1, 60))
    rows = [(5, same), (3, same), (3, same), (None, same), (8, "another text here"), (9, None), (4, "")]
    docs = documents(spark, rows)
    kept = sh.keep_one(docs, 3, 2)
    assert kept.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept.collect()) == sorted(
        [("3", same), ("None", same), ("8", "another text here"), ("4", "")])
