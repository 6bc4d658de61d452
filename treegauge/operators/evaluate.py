"""How well do the search layers find what they should?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import Refused
from ..functions import text as X
from ..session import cut_lineage
from .fusion import CUT

LAYERS = ("lexical", "vector", "fusion")

# Classes of questions, and how many each needs.
CLASSES = ("A", "B", "C")
PER_CLASS = 20
IN_ALL = 60


def recall_rows(gold: DataFrame, ranked: DataFrame, cut: int = CUT) -> DataFrame:
    """`qid, class, lexical, vector, fusion`: any target in a layer's first `cut`.

    `gold(qid, class, target)` has a row per target; `ranked(layer, qid, path,
    position)` a row per hit.
    """
    top = ranked.filter(F.col("position") <= cut)
    found = (gold.join(top, (gold["qid"] == top["qid"]) & (gold["target"] == top["path"]))
             .select(gold["qid"], "layer").distinct())
    flags = found.groupBy("qid").agg(
        *[F.bool_or(F.col("layer") == layer).alias(layer) for layer in LAYERS])
    asked = gold.select("qid", "class").distinct()
    return asked.join(flags, "qid", "left").select(
        "qid", "class", *[F.coalesce(layer, F.lit(False)).alias(layer) for layer in LAYERS])


def recall_tally(rows: DataFrame) -> DataFrame:
    """Hits and totals per class and layer; classes are never blended."""
    return rows.groupBy("class").agg(
        *[F.count_if(layer).alias(layer + "_hits") for layer in LAYERS],
        F.count(F.lit(1)).alias("total"))


#: Words of a shingle that questions and documents meet on.
SHINGLE = 5


def _shingles(words: Column) -> Column:
    """Distinct hashes of all runs of SHINGLE words: as many lists side by side, each moved by one."""
    moved = [F.slice(words, F.lit(k + 1), F.greatest(F.size(words) - (SHINGLE - 1), F.lit(0)))
             for k in range(SHINGLE)]
    return F.array_distinct(F.transform(F.arrays_zip(*moved), lambda run: F.xxhash64(run)))


def holders(questions: DataFrame, docs: DataFrame) -> DataFrame:
    """`qid, target`: documents whose text holds a question `query` whole, letter for letter.

    Word shingles meet first; a document with as many of a question's shingles
    as there are is then tested for the text itself.  The first and last word
    are left out of the shingles, for a document may continue them.  Questions
    with too few words for a shingle meet on the inner words that they have,
    in a pass of their own for each number of words, and only those without an
    inner word are tested against every text.
    """
    asked = questions.select("qid", "query", F.split("query", r"\s+", -1).alias("words"))
    inner = F.slice("words", 2, F.greatest(F.size("words") - 2, F.lit(0)))
    asked = cut_lineage(asked.select("qid", "query", inner.alias("inner")))
    wanted = asked.select("qid", _shingles(F.col("inner")).alias("all")).select(
        "qid", F.size("all").alias("n"), F.explode("all").alias("h"))
    words = docs.select("path", F.split("text", r"\s+", -1).alias("words"))
    met = words.select("path", F.explode(_shingles(F.col("words"))).alias("h")).join(wanted, "h").groupBy(
        "qid", "path", "n").agg(F.count(F.lit(1)).alias("m")).filter("m = n").select("qid", "path")
    short = asked.select("qid", F.size("inner").alias("n"), F.xxhash64("inner").alias("h")).filter(
        F.col("n") < SHINGLE)
    for row in short.select("n").distinct().filter("n > 0").collect():
        n = row["n"]
        moved = [F.slice("words", F.lit(k + 1), F.greatest(F.size("words") - (n - 1), F.lit(0))) for k in range(n)]
        runs = F.array_distinct(F.transform(F.arrays_zip(*moved), lambda run: F.xxhash64(
            F.array(*[run[str(k)] for k in range(n)]))))
        met = met.unionByName(words.select("path", F.explode(runs).alias("h")).join(
            short.filter(F.col("n") == n).select("qid", "h"), "h").select("qid", "path"))
    found = met.join(asked.select("qid", "query"), "qid").join(docs.select("path", "text"), "path").filter(
        F.contains("text", "query")).select("qid", F.col("path").alias("target"))
    bare = asked.join(short.filter("n = 0").select("qid"), "qid", "left_semi").select("qid", "query")
    if not bare.isEmpty():
        found = found.unionByName(docs.join(bare, F.contains("text", "query")).select(
            "qid", F.col("path").alias("target")))
    # Narrow rows that are asked for more than once; the texts are gone through once.
    return cut_lineage(found)


def scored(pairs: DataFrame, gold: DataFrame, corpus: DataFrame, lexical: DataFrame,
           ranked: DataFrame) -> DataFrame:
    """`recall_tally` of a question set that can be scored; a broken one is refused with its reasons."""
    wrong = problems(pairs, gold, corpus, lexical).groupBy("problem").agg(
        F.count(F.lit(1)).alias("n"), F.min("qid").alias("qid")).orderBy("problem").collect()
    if wrong:
        raise Refused("the question set cannot be scored: " + "; ".join(
            "%s (%d, first %s)" % (r["problem"], r["n"], r["qid"]) for r in wrong))
    return recall_tally(recall_rows(gold.join(pairs.select("qid", "class"), "qid"), ranked))


def problems(pairs: DataFrame, gold: DataFrame, corpus: DataFrame,
             lexical: DataFrame) -> DataFrame:
    """Every reason a question set cannot be scored: `qid, problem`.

    `pairs(qid, class, query)`, `gold(qid, target)`, `corpus(path)`,
    `lexical(qid, path, rank)`, all hits.  An empty answer means it can be scored.
    """
    def say(df: DataFrame, problem: str) -> DataFrame:
        return df.select(F.col("qid").cast("string").alias("qid"), F.lit(problem).alias("problem"))

    hits = lexical.groupBy("qid").agg(F.count(F.lit(1)).alias("hits"))
    best = Window.partitionBy("qid").orderBy("rank", "path")
    first = (lexical.withColumn("position", F.row_number().over(best))
             .filter(F.col("position") <= CUT))
    on_target = (gold.join(first.withColumnRenamed("path", "target"), ["qid", "target"])
                 .select("qid").distinct().withColumn("on_target", F.lit(True)))
    judged = pairs.join(hits, "qid", "left").join(on_target, "qid", "left")
    repeated = (pairs.groupBy("query").agg(F.min("qid").alias("first_qid"))
                .join(pairs, "query").filter(F.col("qid") != F.col("first_qid")))
    absent = gold.join(corpus.select(F.col("path").alias("target")), "target", "left_anti")
    relative = ~F.startswith(F.col("target"), F.lit("/"))
    found = say(pairs.filter(~F.col("class").isin(*CLASSES)), "unknown class")
    for part in (
            say(repeated, "duplicate query"),
            say(pairs.join(gold, "qid", "left_anti"), "no target"),
            say(gold.filter(~relative), "absolute target"),
            say(absent.filter(relative), "target not in the corpus"),
            say(judged.filter(F.col("class").isin("A", "C") & (F.col("hits") > 0)),
                "found lexically"),
            say(judged.filter((F.col("class") == "B") & F.col("on_target").isNull()),
                "not found lexically")):
        found = found.unionByName(part)
    counts = pairs.agg(*[F.count_if(F.col("class") == c).alias(c) for c in CLASSES],
                       F.count(F.lit(1)).alias("all"))
    short = counts.select(F.explode(F.array(
        *[F.when(F.col(c) < PER_CLASS, F.lit("class %s is too small" % c)) for c in CLASSES],
        F.when(F.col("all") < IN_ALL, F.lit("the set is too small")))).alias("problem"))
    return found.unionByName(short.filter(F.col("problem").isNotNull()).select(
        F.lit("*").alias("qid"), "problem"))


def splitting_queries(content: DataFrame, per_cause: int = 30) -> DataFrame:
    """`cause, query, n`: the most frequent splittable words, as split queries.

    Words that only a case or digit boundary splits are kept apart from words
    a separator splits.
    """
    word = (content.filter(F.col("text").isNotNull())
            .select(F.explode(X.splittable_words("text"))
                    .alias("word")))
    parts = X.split_identifier("word")
    pieces = F.size(F.filter(F.split("word", r"[^0-9A-Za-z]+", -1), lambda p: p != ""))
    split = (word.select(parts.alias("parts"), pieces.alias("pieces"))
             .filter((F.size("parts") > 1)
                     & F.forall("parts", lambda p: F.length(p) > 1))
             .select(F.when(F.col("pieces") > 1, F.lit("separator"))
                     .otherwise(F.lit("case")).alias("cause"),
                     F.array_join("parts", " ").alias("query"))
             .groupBy("cause", "query").agg(F.count(F.lit(1)).alias("n")))
    order = Window.partitionBy("cause").orderBy(F.desc("n"), "query")
    return (split.withColumn("place", F.row_number().over(order))
            .filter(F.col("place") <= per_cause))


def splitting_recall(content: DataFrame, asked: DataFrame) -> DataFrame:
    """`cause, queries, with_symbols, without_symbols`: split queries with a hit.

    All words of a query must occur in one document; without the symbols
    column only the text may supply them.  Documents are told apart only by
    which of the asked words they hold, so the words, which every task
    carries, meet each such set once.
    """
    from .search import term_sets

    asked = cut_lineage(asked.select("cause", "query", F.array_distinct(F.split("query", " ", -1)).alias("words")))
    words = asked.select("cause", "query", F.explode("words").alias("term"))
    terms = [r["term"] for r in words.select("term").distinct().orderBy("term").collect()]
    place = content.sparkSession.createDataFrame(list(enumerate(terms)), "place int, term string")
    words = cut_lineage(words.join(place, "term").select("cause", "query", "place"))
    needed = asked.select("cause", "query", F.size("words").alias("needed"))
    held = term_sets(content, terms).withColumn("id", F.monotonically_increasing_id()).select("id", F.inline("found"))
    per_query = (held.join(F.broadcast(words), "place").groupBy("cause", "query", "id")
                 .agg(F.count(F.lit(1)).alias("any_n"), F.count_if("in_text").alias("text_n")))
    best = per_query.groupBy("cause", "query").agg(
        F.max("any_n").alias("any_n"), F.max("text_n").alias("text_n"))
    return (needed.join(best, ["cause", "query"], "left").groupBy("cause").agg(
        F.count(F.lit(1)).alias("queries"),
        F.count_if(F.col("any_n") >= F.col("needed")).alias("with_symbols"),
        F.count_if(F.col("text_n") >= F.col("needed")).alias("without_symbols")))
