from pyspark.sql import functions as F

from treegauge.operators import evaluate as ev, fusion as fu


def _lists(spark, **lists):
    rows = [(name, path, i) for name, paths in lists.items() for i, path in enumerate(paths)]
    df = spark.createDataFrame(rows, "list string, path string, place int")
    return fu.positions(df, ["list"], [F.col("place")])


def test_ranks_decide_and_not_scores(spark):
    got = fu.top(fu.fuse(_lists(spark, lexical=["a", "b"], vector=["c", "b"]))).collect()
    assert [r["path"] for r in got] == ["b", "a", "c"]
    assert abs(got[0]["score"] - 2 / 62) < 1e-12 and abs(got[1]["score"] - 1 / 61) < 1e-12
    assert [r["route"] for r in got] == ["both", "lexical", "vector"]
    assert got[0]["found_by"] == {"lexical": 2, "vector": 2}


def test_exact_tie_goes_to_the_better_place(spark):
    def placed(prefix, where):
        return [where.get(i, "%s%02d" % (prefix, i)) for i in range(1, max(where) + 1)]
    lists = _lists(spark, lexical=placed("l", {3: "zzz", 10: "aaa"}),
                   vector=placed("r", {30: "aaa", 45: "zzz"}))
    assert [r["path"] for r in fu.top(fu.fuse(lists)).collect()][:2] == ["zzz", "aaa"]


def test_a_repeated_path_counts_once_at_its_first_place(spark):
    got = {r["path"]: r for r in fu.fuse(_lists(spark, lexical=["a", "b", "a", "c"])).collect()}
    assert got["a"]["score"] == 1 / 61 and got["c"]["best"] == 3


def test_recall_is_per_class_and_layer(spark, rows):
    gold = spark.createDataFrame([(1, "A", "x"), (1, "A", "y"), (2, "B", "z"), (3, "B", "w")],
                                 "qid bigint, class string, target string")
    ranked = spark.createDataFrame([
        ("lexical", 1, "y", 10), ("lexical", 2, "z", 11), ("vector", 2, "z", 1), ("fusion", 1, "x", 1)],
        "layer string, qid bigint, path string, position int")
    tally = {r["class"]: tuple(r)[1:] for r in ev.recall_tally(ev.recall_rows(gold, ranked)).collect()}
    assert tally == {"A": (1, 0, 1, 1), "B": (0, 1, 0, 2)}


def test_a_broken_question_set_is_refused_with_reasons(spark, rows):
    pairs = spark.createDataFrame([(1, "A", "q"), (2, "B", "q"), (3, "X", "r"), (4, "C", "s")],
                                  "qid bigint, class string, query string")
    gold = spark.createDataFrame([(1, "in"), (2, "out"), (3, "/abs")], "qid bigint, target string")
    corpus = spark.createDataFrame([("in",)], "path string")
    lexical = spark.createDataFrame([(1, "in", -1.0)], "qid bigint, path string, rank double")
    got = rows(ev.problems(pairs, gold, corpus, lexical).filter("qid <> '*'"))
    assert got == [("1", "found lexically"), ("2", "duplicate query"), ("2", "not found lexically"),
                   ("2", "target not in the corpus"), ("3", "absolute target"), ("3", "unknown class"),
                   ("4", "no target")]


def test_splitting_recall_needs_the_symbols_column(spark, rows):
    content = spark.createDataFrame([("a", "getUserName here"), ("b", "snake_case_word")],
                                    "path string, text string")
    asked = ev.splitting_queries(content)
    assert rows(asked.select("cause", "query")) == [("case", "get user name"),
                                                    ("separator", "snake case word")]
    assert rows(ev.splitting_recall(content, asked)) == [("case", 1, 1, 0), ("separator", 1, 1, 1)]
