"""Full-text search: BM25 over two columns, text and split identifiers.

Two ways to the same answer.  `search` scans the content once and needs no
index; `build_index` / `search_index` keep postings, so a query reads only the
rows of its own terms.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, Window

from ..functions import text as X
from ..functions.places import places, stretches
from ..session import cut_lineage

# The ranking parameters and the floor of the term weight.
K1 = 1.2
B = 0.75
IDF_FLOOR = 1e-6
#: Asked terms that one pass over the text looks for.
ASKED = 50_000


def prepared(content: DataFrame) -> DataFrame:
    """`path, t, s`: searchable forms of the text and of its symbols."""
    return content.filter(F.col("text").isNotNull()).select(
        "path", X.searchable("text").alias("t"),
        X.searchable(X.symbols("text")).alias("s"))


def _idf(n: Column, df: Column) -> Column:
    raw = F.ln((n - df + F.lit(0.5)) / (df + F.lit(0.5)))
    return F.when(raw <= 0.0, F.lit(IDF_FLOOR)).otherwise(raw)


def _weight(tf: Column, dl: Column, avgdl: Column) -> Column:
    tf = tf.cast("double")
    return tf * F.lit(K1 + 1.0) / (
        tf + F.lit(K1) * (F.lit(1.0 - B) + F.lit(B) * dl / avgdl))


def scored(content: DataFrame, query: str) -> DataFrame | None:
    """`path, rank, place` for every document that matches the whole query.

    The text is read once: what leaves the scan is a path and a few counts.
    Those are written down, because both the corpus statistics and the scores
    need them and the optimizer would otherwise tokenise the corpus twice.
    """
    phrases = X.query_phrases(query)
    if not phrases:
        return None
    counted = prepared(content).select(
        "path", (X.token_count("t") + X.token_count("s")).alias("dl"),
        *[X.occurrences("t", p).alias("t%d" % i) for i, p in enumerate(phrases)],
        *[X.occurrences("s", p).alias("s%d" % i) for i, p in enumerate(phrases)])
    counted = cut_lineage(counted)
    each = range(len(phrases))
    hit = [F.col("t%d" % i) + F.col("s%d" % i) for i in each]
    stats = counted.agg(F.struct(
        F.count("path").alias("n"), F.avg("dl").alias("avgdl"),
        *[F.count_if(hit[i] > 0).alias("df%d" % i) for i in each])).scalar()
    rank, all_hit, all_text = F.lit(0.0), F.lit(True), F.lit(True)
    for i in each:
        rank = rank - _idf(stats["n"], stats["df%d" % i]) * _weight(
            hit[i], F.col("dl"), stats["avgdl"])
        all_hit = all_hit & (hit[i] > 0)
        all_text = all_text & (F.col("t%d" % i) > 0)
    return counted.filter(all_hit).select(
        "path", rank.alias("rank"),
        F.when(all_text, F.lit("text")).otherwise(F.lit("symbols")).alias("place"))


def search(content: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Best documents first (lower rank is better), ties by path."""
    hits = scored(content, query)
    if hits is None:
        return content.limit(0).select(
            "path", F.lit(0.0).alias("rank"), F.lit("text").alias("place"))
    return hits.orderBy("rank", "path").limit(limit)


# -- the index --------------------------------------------------------------

def token_rows(content: DataFrame) -> DataFrame:
    """`path, col, pos, term`: every token of both columns, nothing shuffled."""
    forms = prepared(content).select(
        "path", F.explode(F.array(
            F.struct(F.lit("text").alias("col"), F.col("t").alias("form")),
            F.struct(F.lit("symbols").alias("col"), F.col("s").alias("form")))).alias("f"))
    return forms.select("path", "f.col", F.posexplode(X.tokens("f.form")).alias("pos", "term"))


def postings(content: DataFrame) -> DataFrame:
    """`term, path, col, positions`: one row per term, document and column.

    Positions are those of one document, so the list is as long as a document
    at most.  The key spreads a frequent term over all its documents.
    """
    return token_rows(content).groupBy("term", "path", "col").agg(
        F.array_sort(F.collect_list("pos")).alias("positions"))


def term_documents(content: DataFrame) -> DataFrame:
    """`term, path` once per document, made distinct inside the row."""
    return prepared(content).select("path", F.explode(F.array_distinct(
        F.concat(X.tokens("t"), X.tokens("s")))).alias("term"))


def lengths(content: DataFrame) -> DataFrame:
    return prepared(content).select(
        "path", (X.token_count("t") + X.token_count("s")).alias("dl"))


def write_index(content: DataFrame, folder: str) -> None:
    """Postings sorted by term, so a query prunes row groups by statistics.

    Ranges are over (term, path): a term found everywhere spans many files.
    """
    (postings(content).repartitionByRange("term", "path")
     .sortWithinPartitions("term", "path")
     .write.mode("overwrite").parquet(folder + "/postings"))
    lengths(content).write.mode("overwrite").parquet(folder + "/lengths")


def search_index(index: DataFrame, doc_lengths: DataFrame, query: str,
                 limit: int = 20) -> DataFrame:
    """The same answer as `search`, from postings and document lengths."""
    phrases = X.query_phrases(query)
    if not phrases:
        return doc_lengths.limit(0).select(
            "path", F.lit(0.0).alias("rank"), F.lit("text").alias("place"))
    terms = sorted({t for p in phrases for t in p})
    wanted = index.filter(F.col("term").isin(*terms))
    empty = F.array().cast("array<int>")

    def where(col: str, term: str) -> Column:
        return F.coalesce(F.max(F.when((F.col("col") == col) & (F.col("term") == term),
                                       F.col("positions"))), empty)

    per_doc = wanted.groupBy("path").agg(
        *[where(col, t).alias("%s%d" % (col[0], i))
          for col in ("text", "symbols") for i, t in enumerate(terms)])

    def times(col: str, phrase: list[str]) -> Column:
        starts = F.col("%s%d" % (col, terms.index(phrase[0])))
        for offset, term in enumerate(phrase[1:], start=1):
            other = F.col("%s%d" % (col, terms.index(term)))
            starts = F.array_intersect(starts, _moved_back(other, offset))
        return F.size(starts)

    each = range(len(phrases))
    counted = per_doc.select(
        "path", *[times("t", p).alias("t%d" % i) for i, p in enumerate(phrases)],
        *[times("s", p).alias("s%d" % i) for i, p in enumerate(phrases)])
    # One row per document that holds any of the words, read twice below.
    counted = cut_lineage(counted)
    hit = [F.col("t%d" % i) + F.col("s%d" % i) for i in each]
    corpus = doc_lengths.agg(F.struct(F.count("path").alias("n"),
                                      F.avg("dl").alias("avgdl"))).scalar()
    dfs = counted.agg(F.struct(*[F.count_if(hit[i] > 0).alias("df%d" % i)
                                 for i in each])).scalar()
    all_hit, all_text, rank = F.lit(True), F.lit(True), F.lit(0.0)
    for i in each:
        all_hit = all_hit & (hit[i] > 0)
        all_text = all_text & (F.col("t%d" % i) > 0)
        rank = rank - _idf(corpus["n"], dfs["df%d" % i]) * _weight(
            hit[i], F.col("dl"), corpus["avgdl"])
    return (counted.filter(all_hit).join(doc_lengths, "path")
            .select("path", rank.alias("rank"),
                    F.when(all_text, F.lit("text")).otherwise(F.lit("symbols"))
                    .alias("place"))
            .orderBy("rank", "path").limit(limit))


def _moved_back(positions: Column, by: int | Column) -> Column:
    by = by if isinstance(by, Column) else F.lit(by)
    return F.transform(positions, lambda p: p - by)


def index_state(content: DataFrame, index_paths: DataFrame | None) -> DataFrame:
    """`state, indexed, expected`; a missing index is not an empty answer."""
    expected = content.filter(F.col("text").isNotNull()).agg(
        F.count(F.lit(1)).alias("expected"))
    if index_paths is None:
        return expected.select(F.lit("missing").alias("state"),
                               F.lit(0).cast("bigint").alias("indexed"), "expected")
    indexed = index_paths.agg(F.count(F.lit(1)).alias("n")).scalar()
    return expected.select(indexed.alias("indexed"), "expected").select(
        F.when(F.col("indexed") != F.col("expected"), F.lit("stale"))
        .otherwise(F.lit("ok")).alias("state"), "indexed", "expected")


# -- many queries -----------------------------------------------------------

def query_terms(queries: DataFrame) -> DataFrame:
    """`qid, phrase, times, n_tokens, offset, term` of a table `queries(qid, query)`.

    `times` is how often the query repeats the phrase; it weighs the score.
    """
    words = F.filter(F.split(F.replace("query", F.lit('"'), F.lit("")), r"(?U)\s+", -1),
                     lambda w: F.rlike(w, F.lit("[0-9A-Za-z]")))
    split = F.transform(words, lambda w: X.tokens(X.searchable(w)))
    counted = F.transform(F.array_distinct(F.col("split")), lambda p: F.struct(
        p.alias("parts"), F.size(F.filter("split", lambda q: q == p)).alias("times")))
    return (queries.select("qid", split.alias("split"))
            .select("qid", F.posexplode(counted).alias("phrase", "found"))
            .select("qid", "phrase", "found.times", F.size("found.parts").alias("n_tokens"),
                    F.posexplode("found.parts").alias("offset", "term")))


def _asked(terms: DataFrame) -> list[pa.Array]:
    """The distinct terms of questions, in blocks that a task carries."""
    asked = [r["term"] for r in terms.select("term").distinct().orderBy("term").toLocalIterator()]
    return [pa.array(asked[i:i + ASKED], pa.string()) for i in range(0, max(1, len(asked)), ASKED)]


def _measured(content: DataFrame) -> DataFrame:
    return prepared(content).select("path", "t", "s", (X.token_count("t") + X.token_count("s")).alias("dl"))


def asked_positions(content: DataFrame, terms: DataFrame) -> DataFrame:
    """`term, path, t, s, dl`: positions of the asked terms, and per document its length.

    A row with the empty term stands for each document.  A document's terms
    meet their positions inside its row, and tokens that nobody asks for go no
    further, so nothing is shuffled.  Over ASKED terms the text is read once
    more for each block of them.  A path is one row of the content.
    """
    numbers = pa.list_(pa.int32())

    def of(wanted: pa.Array, first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in stretches(batch, "t", "s"):
                    path, t, s, dl = part.columns
                    if first:
                        empty = pa.array([[]] * len(path), numbers)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([""] * len(path)), path, empty, empty, dl], ["term", "path", "t", "s", "dl"])
                    names, code, row, in_text, in_symbols = places(t, s, wanted)
                    row = pa.array(row)
                    yield pa.RecordBatch.from_arrays(
                        [names.take(pa.array(code)), path.take(row), in_text, in_symbols, dl.take(row)],
                        ["term", "path", "t", "s", "dl"])

        return _measured(content).mapInArrow(run, "term string, path string, t array<int>, s array<int>, dl int")

    return reduce(DataFrame.unionByName, [of(wanted, i == 0) for i, wanted in enumerate(_asked(terms))])


def term_sets(content: DataFrame, terms: list[str]) -> DataFrame:
    """`found`: the distinct sets of the given terms that documents hold, as `(place, in_text)` of the list."""
    listed = pa.array(terms, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in stretches(batch, "t", "s"):
                names, code, row, in_text, _ = places(part.column(0), part.column(1), listed)
                place = pc.index_in(names, value_set=listed.cast(names.type)).to_numpy(zero_copy_only=False)[code]
                held = 2 * place.astype(np.int64) + (np.diff(in_text.offsets.to_numpy()) > 0)
                order = np.lexsort((held, row))
                edges = np.flatnonzero(np.diff(row[order], prepend=-1))
                sets = {tuple(own.tolist()) for own in np.split(held[order], edges[1:]) if len(own)}
                yield pa.RecordBatch.from_arrays([pa.array(
                    [[{"place": h // 2, "in_text": bool(h % 2)} for h in own] for own in sorted(sets)],
                    pa.list_(pa.struct([("place", pa.int32()), ("in_text", pa.bool_())])))], ["found"])

    return prepared(content).select("t", "s").mapInArrow(
        run, "found array<struct<place:int,in_text:boolean>>").distinct()


def term_stats(content: DataFrame) -> DataFrame:
    """`term, docs, uses`: in how many documents a term is, and how often in all.

    Rows are counted a few megabytes at a time before they are shuffled, one
    row per term and task.  If rows share a path, `postings` tells which they are.
    """
    paths = content.groupBy("path").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if not paths.isEmpty():
        return postings(content).groupBy("term").agg(
            F.count_distinct("path").alias("docs"), F.sum(F.size("positions")).alias("uses"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in stretches(batch, "t", "s"):
                names, code, _, in_text, in_symbols = places(part.column(0), part.column(1))
                uses = sum(np.diff(lists.offsets.to_numpy()) for lists in (in_text, in_symbols))
                yield pa.RecordBatch.from_arrays(
                    [names, pa.array(np.bincount(code, minlength=len(names)).astype(np.int64)),
                     pa.array(np.bincount(code, uses, len(names)).astype(np.int64))], ["term", "docs", "uses"])

    return prepared(content).select("t", "s").mapInArrow(run, "term string, docs bigint, uses bigint").groupBy(
        "term").agg(F.sum("docs").alias("docs"), F.sum("uses").alias("uses"))


def search_many(content: DataFrame, queries: DataFrame, depth: int | None = 50) -> DataFrame:
    """`qid, path, rank, position` for a table of queries; all hits without a `depth`.

    The corpus is tokenised once; what is written down is, per asked term and
    document, the positions, and per document its length.  Only documents that
    hold a query's rarest term can match it: those are the candidates, and the
    other terms are looked up by document and term together.
    """
    terms = cut_lineage(query_terms(queries))
    held = cut_lineage(asked_positions(content, terms))
    sizes = held.filter(F.col("term") == "").select("path", "dl")
    found = held.filter(F.col("term") != "").select("term", "path", "t", "s")
    corpus = sizes.agg(F.struct(F.count("path").alias("n"), F.avg("dl").alias("avgdl"))).scalar()
    df = cut_lineage(found.groupBy("term").agg(F.count(F.lit(1)).alias("term_df")))
    known = terms.join(df, "term")
    counts = _phrase_counts(known, found)
    single = (known.filter(F.col("n_tokens") == 1)
              .select("qid", "phrase", "times", F.col("term_df").alias("df"), "term"))
    rare = known.groupBy("qid").agg(F.min_by("term", F.struct("term_df", "term")).alias("term"))
    candidates = rare.join(found.select("term", "path"), "term").select("qid", "path")
    hit = candidates.join(single, "qid").join(found, ["term", "path"]).select(
        "qid", "path", "phrase", "times", "df", (F.size("t") + F.size("s")).alias("tf"))
    if counts is not None:
        phrase_df = counts.groupBy("qid", "phrase").agg(F.count(F.lit(1)).alias("df"))
        hit = hit.unionByName(counts.join(candidates, ["qid", "path"], "left_semi")
                              .join(phrase_df, ["qid", "phrase"])
                              .select("qid", "path", "phrase", "times", "df", "tf"))
    needed = terms.select("qid", "phrase").distinct().groupBy("qid").agg(
        F.count(F.lit(1)).alias("n_phrases"))
    score = -F.col("times") * _idf(corpus["n"], F.col("df")) * _weight(
        F.col("tf"), F.col("dl"), corpus["avgdl"])
    hits = (hit.join(sizes, "path").withColumn("score", score).groupBy("qid", "path")
            .agg(F.sort_array(F.collect_list("score")).alias("parts"))
            .join(needed, "qid").filter(F.size("parts") == F.col("n_phrases"))
            # Added by size: documents whose phrases score the same in any order tie exactly.
            .withColumn("rank", F.aggregate("parts", F.lit(0.0), lambda a, p: a + p)))
    order = Window.partitionBy("qid").orderBy("rank", "path")
    hits = hits.withColumn("position", F.row_number().over(order)).select("qid", "path", "rank", "position")
    return hits if depth is None else hits.filter(F.col("position") <= depth)


def _phrase_counts(known: DataFrame, found: DataFrame) -> DataFrame | None:
    """`qid, phrase, times, path, tf` of phrases of several tokens; none if there are none.

    Documents with the phrase's rarest token are looked at, the other tokens
    being looked up by document and term; positions moved back by their
    offsets meet where the phrase starts.
    """
    longer = known.filter(F.col("n_tokens") > 1)
    if longer.isEmpty():
        return None
    rare = longer.groupBy("qid", "phrase").agg(
        F.min_by("term", F.struct("term_df", "term")).alias("term"))
    places = rare.join(found.select("term", "path"), "term").drop("term")
    parts = places.join(longer, ["qid", "phrase"]).join(found, ["term", "path"]).select(
        "qid", "phrase", "times", "n_tokens", "path", "offset",
        *[_moved_back(F.col(c), F.col("offset")).alias(c) for c in ("t", "s")])

    def meet(col: str) -> Column:
        return F.size(F.aggregate(F.slice("all", 2, F.size("all")), F.col("all")[0][col],
                                  lambda a, x: F.array_intersect(a, x[col])))

    return cut_lineage(
        parts.groupBy("qid", "phrase", "times", "n_tokens", "path")
        .agg(F.array_sort(F.collect_list(F.struct("offset", "t", "s"))).alias("all"))
        .filter(F.size("all") == F.col("n_tokens"))
        .select("qid", "phrase", "times", "path", (meet("t") + meet("s")).alias("tf"))
        .filter("tf > 0"))
