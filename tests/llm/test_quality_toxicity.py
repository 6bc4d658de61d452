import re
import zlib

import numpy as np
from support import ODD, documents, text

from treegauge.llm import ordinal, quality_rules as qr, toxicity as tx


def _base(t):
    own = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(own[i:i + 8]) for i in range(len(own) - 7)]
    again = {w for w in windows if windows.count(w) > 1} if len(windows) < 400 else set(windows[:1])
    inside = {j for i, w in enumerate(windows) if w in again for j in range(i, i + 8)}
    return (len(own), sum(map(len, own)), sum((t or "").count(c) for c in "#*$%&|<>"),
            len(lines) - len(set(lines)), len(inside))


def test_figures_of_whole_texts(spark):
    rows = ODD + [(30, text(1, 60) + " " + text(2, 20) + "\n" + text(2, 20) + " # | %"), (31, text(3, 100))]
    got = {(str(r["doc_id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"],
            r["n_repeat_words"], r["base_failed"], r["kept"]) for r in qr.cascade(documents(spark, rows), qr.RULES).collect()}
    for i, t in rows:
        b = _base(t)
        failed = b[0] < 20 or 100 * b[4] > 30 * b[0]
        assert any(g[:7] == (str(i), *b, failed) and not (failed and g[7]) for g in got), (i, b)
    assert any(g[0] == "31" and g[7] for g in got)
    assert qr.cascade(documents(spark, []), qr.RULES).collect() == []


def test_order_changes_cost_and_not_the_verdict(spark):
    rows = [(i, text(i, 60) + (" %%% $$$" * 30 if i % 3 == 0 else "")) for i in range(40)]
    docs = documents(spark, rows)
    found = qr.estimate(docs, qr.RULES)
    order = qr.ordered(found)
    assert {r.name for r in order} == {r.name for r in qr.RULES}
    sets = [sorted((r["doc_id"], r["kept"]) for r in qr.cascade(docs, rules).collect())
            for rules in (qr.RULES, order, qr.RULES[::-1])]
    assert sets[0] == sets[1] == sets[2] and {k for _, k in sets[0]} == {True, False}
    # A rule with more rejections for the same seconds goes first; one that adds nothing goes last.
    made = [qr.Estimate(qr.RULES[0], 1.0, frozenset({1})), qr.Estimate(qr.RULES[1], 1.0, frozenset({1, 2, 3})),
            qr.Estimate(qr.RULES[2], 0.5, frozenset())]
    assert qr.ordered(made) == (qr.RULES[1], qr.RULES[2], qr.RULES[0])
    assert qr.ordered(qr.estimate(documents(spark, []), qr.RULES))


def test_toxicity_is_learnt_from_labels_and_held_out(spark):
    bad = ["vequmo", "lowei", "wretchstone", "gruzzle"]
    rows = []
    for i in range(400):
        own = text(i, 60).split()
        if i % 4 == 0:
            for k in range(3):
                own.insert(7 * k, bad[(i // 4 + k) % 4])
        rows.append((i, " ".join(own)))
    docs = documents(spark, rows + [(900, None), (901, ""), (902, rows[0][1]), (903, "vequmo " * 4000)])
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)] + [(None, 1, 1), (5000, 0, 1), (3, 0, None)],
                                   "doc_id bigint, quality int, toxic int")
    model = tx.learn(docs, labels)
    got = {r["doc_id"]: r["score"] for r in tx.toxicity(docs, model).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    right = np.mean([(got[i] >= 0.3) == (i % 4 == 0) for i in held])
    assert right > 0.95 and all(0 <= s <= 1 for s in got.values())
    assert got[900] == got[901] == min(got.values()) and got[902] == got[0] and got[903] >= 0.3
    assert tx.scored(docs, model).columns == docs.columns + ["_score"]
    # Labels of the held-out fold change nothing.
    other = labels.replace({0: 1}, subset=["toxic"]).join(
        spark.createDataFrame([(i,) for i in held], "doc_id bigint"), "doc_id", "left_semi")
    same = tx.learn(docs, labels.join(other, "doc_id", "left_anti").select(labels.columns).unionByName(other))
    assert same.weights == model.weights
    assert tx.toxicity(documents(spark, []), model).collect() == []
    none = tx.learn(docs, labels.limit(0))
    assert {r["score"] for r in tx.toxicity(docs, none).collect()} == {0.05}


def test_ordinal_grades_follow_the_ratings(spark):
    rows = [(i, ("%s ### | $$$ " % text(i, 10) * 6 if i % 3 == 0 else text(i, 60) + (" grumbling" * 3 if i % 3 == 1 else "")))
            for i in range(300)]
    docs = documents(spark, rows + [(900, None), (901, ""), (902, rows[1][1])])
    ratings = spark.createDataFrame([(i, i % 3) for i in range(300)] + [(None, 1), (2, None)], "doc_id bigint, grade int")
    model = ordinal.learn(docs, ratings, 3)
    assert (np.diff(model.thresholds) > 0).all()
    got = {r["doc_id"]: r for r in ordinal.grade(docs, model).collect()}
    mean = [np.mean([got[i]["expected_grade"] for i in range(300) if i % 3 == k and zlib.crc32(str(i).encode()) % 4 == 2])
            for k in range(3)]
    assert mean[0] < mean[1] < mean[2]
    assert got[902]["expected_grade"] == got[1]["expected_grade"] and got[900]["kept"] == got[901]["kept"]
    assert np.mean([got[i]["kept"] for i in range(300) if i % 3]) > 0.95
    assert np.mean([got[i]["kept"] for i in range(300) if i % 3 == 0]) < 0.3
    assert ordinal.grade(documents(spark, []), model).collect() == []
    assert len(ordinal.grade(docs, ordinal.learn(docs, ratings.limit(0), 3)).collect()) == len(rows) + 3


def test_repeated_windows_against_a_plain_count():
    rng = np.random.default_rng(2)
    for n in (0, 7, 8, 9, 30, 200):
        numbers = rng.integers(0, 3, n)
        windows = [tuple(numbers[i:i + 8]) for i in range(n - 7)]
        want = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)}
        assert qr.repeated_words(numbers, 8) == len(want)
