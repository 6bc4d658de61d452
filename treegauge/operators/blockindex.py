"""A stored full-text index of posting blocks with bounds, and a search that skips blocks.

Documents stand in the order of their length and are cut into ranges.  A block
holds one term's documents of one range, with the greatest count and the least
length in it; together they bound what the term can add to any score there.
Documents of like length stand together, so bounds are close.  A search reads
the bounds of its terms first, then the blocks of the ranges with the highest
bounds, and then only those of ranges whose bound reaches the worst of the best
found so far.  Text is never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window

from ..functions import text as X
from ..functions.places import places
from ..session import cut_lineage
from .search import _idf, _moved_back, _weight, prepared

#: Documents of a range (a power of two), and ranges that are read before the others are judged.
RANGE, FIRST = 256, 8
#: Neighbouring ranges whose blocks of a term lie in one file.
SPREAD = 64

_BLOCKS = ("term string, range bigint, n int, max_tf int, min_dl int, place array<int>, dl array<int>, "
           "t array<array<int>>, s array<array<int>>, path array<string>")


def _numbered(content: DataFrame, parts: int | None) -> DataFrame:
    """`path, t, s, dl, id`: searchable forms dealt by path, each task's in the order of length.

    Ids rise inside a task and leave gaps between tasks.
    """
    forms = prepared(content).withColumn("dl", X.token_count("t") + X.token_count("s"))
    dealt = forms.repartition(parts, "path") if parts else forms.repartition("path")
    return dealt.sortWithinPartitions("dl", "path").withColumn("id", F.monotonically_increasing_id())


def _blocks_of(docs: list[pa.RecordBatch], number: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The blocks of one range from its documents `path, t, s, dl, id`."""
    path, t, s, dl, ids = (pa.concat_arrays([d.column(k) for d in docs]) for k in range(5))
    place, dl = (ids.to_numpy() % RANGE).astype(np.int32), dl.to_numpy().astype(np.int32)
    whole = pa.array([0, len(place)], pa.int32())
    yield pa.RecordBatch.from_arrays([
        pa.array([""]), pa.array([number]), pa.array([len(place)], pa.int32()), pa.array([0], pa.int32()),
        pa.array([dl.min()], pa.int32()), pa.ListArray.from_arrays(whole, pa.array(place)),
        pa.ListArray.from_arrays(whole, pa.array(dl)), pa.nulls(1, schema.field("t").type),
        pa.nulls(1, schema.field("s").type), pa.ListArray.from_arrays(whole, path.cast(pa.string()))], schema=schema)
    terms, code, row, in_text, in_symbols = places(t, s)
    first = np.flatnonzero(np.diff(code, prepend=-1))
    if not len(first):
        return
    tf = sum(np.diff(lists.offsets.to_numpy()) for lists in (in_text, in_symbols))
    edges = np.append(first, len(code)).astype(np.int32)
    made = pa.RecordBatch.from_arrays([
        terms.take(pa.array(code[first])).cast(pa.string()), pa.array(np.full(len(first), number)),
        pa.array(np.diff(edges)), pa.array(np.maximum.reduceat(tf, first)),
        pa.array(np.minimum.reduceat(dl[row], first)), *[pa.ListArray.from_arrays(pa.array(edges), lists) for lists in (
            pa.array(place[row]), pa.array(dl[row]), in_text, in_symbols)],
        pa.nulls(len(first), schema.field("path").type)], schema=schema)
    for i in range(0, len(first), 4096):
        yield made.slice(i, 4096)


def blocks(content: DataFrame, parts: int | None = None) -> DataFrame:
    """One row per term and range, and one with the empty term for the documents of the range.

    Terms meet their places for all documents of a range at once; only
    finished blocks go on.
    """
    numbers = pa.list_(pa.int32())
    schema = pa.schema([("term", pa.string()), ("range", pa.int64()), ("n", pa.int32()), ("max_tf", pa.int32()),
                        ("min_dl", pa.int32()), ("place", numbers), ("dl", numbers), ("t", pa.list_(numbers)),
                        ("s", pa.list_(numbers)), ("path", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, docs = None, []
        for batch in batches:
            ranges = batch.column(4).to_numpy() // RANGE
            edges = np.append(np.flatnonzero(np.diff(ranges, prepend=-1)), len(ranges)).tolist()
            for a, b in zip(edges, edges[1:]):
                if docs and ranges[a] != now:
                    yield from _blocks_of(docs, int(now), schema)
                    docs = []
                now = ranges[a]
                docs.append(batch.slice(a, b - a))
        if docs:
            yield from _blocks_of(docs, int(now), schema)

    return _numbered(content, parts).select("path", "t", "s", "dl", "id").mapInArrow(run, _BLOCKS)


def write(content: DataFrame, folder: str, parts: int | None = None) -> None:
    """Blocks sorted by term and range, so a term's rows are found by the files' statistics.

    A term's blocks are dealt by SPREAD ranges: one that is everywhere lies in many files.
    """
    spread = F.col("range") - F.pmod(F.col("range"), F.lit(SPREAD))
    (blocks(content, parts).repartition("term", spread).sortWithinPartitions("term", "range")
     .write.mode("overwrite").parquet(folder + "/blocks"))
    spark = content.sparkSession
    sizes = spark.read.parquet(folder + "/blocks").filter(F.col("term") == "").select(
        F.explode("dl").alias("dl"))
    sizes.agg(F.count("dl").alias("n"), F.avg("dl").alias("avgdl")).coalesce(1).write.mode(
        "overwrite").parquet(folder + "/corpus")


class Index:
    """A written index; searches give the rows of `search.search`."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.blocks = spark.read.parquet(folder + "/blocks")
        corpus = spark.read.parquet(folder + "/corpus").first()
        self.n, self.avgdl = corpus["n"], corpus["avgdl"]

    def _nothing(self) -> DataFrame:
        return self.blocks.limit(0).select(
            F.col("term").alias("path"), F.lit(0.0).alias("rank"), F.lit("text").alias("place"))

    def _rank(self, dfs: list[Column], tfs: list[Column], dl: Column) -> Column:
        rank = F.lit(0.0)
        for df, tf in zip(dfs, tfs, strict=True):
            rank = rank - _idf(F.lit(self.n), df) * _weight(tf, dl, F.lit(self.avgdl))
        return rank

    def search(self, query: str, limit: int = 20) -> DataFrame:
        """Best documents first (lower rank is better), ties by path."""
        phrases = X.query_phrases(query)
        if not phrases or not self.n:
            return self._nothing()
        if any(len(p) != 1 for p in phrases):
            return self._named(self._phrases(phrases), limit)
        hits, _ = self._words([p[0] for p in phrases], limit)
        return self._nothing() if hits is None else self._named(hits, limit)

    def blocks_read(self, query: str, limit: int = 20) -> tuple[int, int]:
        """Blocks of the query's words that a search reads, and all there are."""
        words = [p[0] for p in X.query_phrases(query)]
        of_all = self.blocks.filter(F.col("term").isin(words)).count()
        _, ranges = self._words(words, limit)
        return (0 if ranges is None else ranges.count() * len(set(words))), of_all

    def _words(self, words: list[str], limit: int) -> tuple[DataFrame | None, DataFrame | None]:
        """(hits, ranges read) of a query of single words.

        Ranges without one of the words, and ranges that cannot reach the
        `limit`-th best of the first ones, are left out.
        """
        terms = sorted(set(words))
        wanted = self.blocks.filter(F.col("term").isin(terms))
        heads = cut_lineage(wanted.select("term", "range", "n", "max_tf", "min_dl"))
        told = {r["term"]: r["df"] for r in heads.groupBy("term").agg(F.sum("n").alias("df")).collect()}
        if len(told) < len(terms):
            return None, None
        dfs = [F.lit(told[w]) for w in words]

        def of(term: str, column: str) -> Column:
            return F.max(F.when(F.col("term") == term, F.col(column)))

        ranges = heads.groupBy("range").agg(
            *[of(t, "max_tf").alias("m%d" % i) for i, t in enumerate(terms)], F.min("min_dl").alias("dl")).select(
            # A bit above what rounding could make of the best document there.
            "range", (-self._rank(dfs, [F.col("m%d" % terms.index(w)) for w in words], F.col("dl"))
                      * F.lit(1 + 1e-12)).alias("bound")).filter(F.col("bound").isNotNull())
        ranges = cut_lineage(ranges)
        first = [r["range"] for r in ranges.orderBy(F.desc("bound"), "range").limit(FIRST).collect()]
        hits = cut_lineage(self._scored(wanted.filter(F.col("range").isin(first)), words, terms, dfs))
        worst = hits.orderBy("rank").limit(limit).agg(
            F.count("rank").alias("n"), F.max("rank").alias("rank")).first()
        if worst["n"] == limit:
            ranges = ranges.filter(F.col("bound") >= F.lit(-worst["rank"]))
        more = ranges.filter(~F.col("range").isin(first)) if first else ranges
        rest = self._scored(wanted.join(more.select("range"), "range", "left_semi"), words, terms, dfs)
        return hits.unionByName(rest), more.select("range").unionByName(
            self.spark.createDataFrame([(r,) for r in first], "range bigint"))

    def _scored(self, wanted: DataFrame, words: list[str], terms: list[str], dfs: list[Column]) -> DataFrame:
        """`range, place, rank, found` of documents with all words."""
        rows = wanted.select("term", "range", F.explode(F.arrays_zip(
            "place", "dl", F.transform("t", F.size).alias("t"), F.transform("s", F.size).alias("s"))).alias("d")).select(
            "term", "range", F.col("d.place").alias("place"), F.col("d.dl").alias("dl"),
            (F.col("d.t") + F.col("d.s")).alias("tf"), (F.col("d.t") > 0).alias("in_text"))

        def of(term: str, column: str) -> Column:
            return F.max(F.when(F.col("term") == term, F.col(column)))

        per_doc = rows.groupBy("range", "place").agg(
            F.first("dl").alias("dl"), *[of(t, "tf").alias("f%d" % i) for i, t in enumerate(terms)],
            F.bool_and("in_text").alias("all_text"))
        tfs = [F.col("f%d" % terms.index(w)) for w in words]
        return per_doc.dropna(subset=["f%d" % i for i in range(len(terms))]).select(
            "range", "place", self._rank(dfs, tfs, F.col("dl")).alias("rank"),
            F.when(F.col("all_text"), F.lit("text")).otherwise(F.lit("symbols")).alias("found"))

    def _phrases(self, phrases: list[list[str]]) -> DataFrame:
        """The same for a query with phrases; how many documents hold one is known from all places only."""
        terms = sorted({t for p in phrases for t in p})
        empty = F.array().cast("array<int>")
        rows = self.blocks.filter(F.col("term").isin(terms)).select("term", "range", F.explode(F.arrays_zip(
            "place", "dl", "t", "s")).alias("d")).select("term", "range", "d.*")
        per_doc = rows.groupBy("range", "place").agg(F.first("dl").alias("dl"), *[
            F.coalesce(F.max(F.when(F.col("term") == t, F.col(c))), empty).alias("%s%d" % (c, i))
            for c in ("t", "s") for i, t in enumerate(terms)])

        def times(column: str, phrase: list[str]) -> Column:
            if not phrase:
                return F.lit(0)
            starts = F.col("%s%d" % (column, terms.index(phrase[0])))
            for offset, term in enumerate(phrase[1:], start=1):
                starts = F.array_intersect(starts, _moved_back(F.col("%s%d" % (column, terms.index(term))), offset))
            return F.size(starts)

        counted = cut_lineage(per_doc.select(
            "range", "place", "dl", *[times(c, p).alias("n%s%d" % (c, i))
                                      for c in ("t", "s") for i, p in enumerate(phrases)]))
        each = range(len(phrases))
        tfs = [F.col("nt%d" % i) + F.col("ns%d" % i) for i in each]
        dfs = counted.agg(*[F.count_if(tfs[i] > 0).alias("df%d" % i) for i in each]).first()
        hit, in_text = F.lit(True), F.lit(True)
        for i in each:
            hit, in_text = hit & (tfs[i] > 0), in_text & (F.col("nt%d" % i) > 0)
        return counted.filter(hit).select(
            "range", "place", self._rank([F.lit(d) for d in dfs], tfs, F.col("dl")).alias("rank"),
            F.when(in_text, F.lit("text")).otherwise(F.lit("symbols")).alias("found"))

    def _named(self, hits: DataFrame, limit: int) -> DataFrame:
        """The best with their paths; those that tie with the last one are told apart by path."""
        best = hits.withColumn("at", F.rank().over(Window.orderBy("rank"))).filter(F.col("at") <= limit)
        docs = self.blocks.filter(F.col("term") == "").join(
            best.select("range").distinct(), "range", "left_semi").select(
            "range", F.explode(F.arrays_zip("place", "path")).alias("d")).select("range", "d.place", "d.path")
        return best.join(docs, ["range", "place"]).select(
            "path", "rank", F.col("found").alias("place")).orderBy("rank", "path").limit(limit)
