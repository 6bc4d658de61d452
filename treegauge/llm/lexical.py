"""Ranked lexical search: term at a time over short lists, document at a time over long ones.

Documents are partitioned; a task holds inverted lists of its own documents for
the terms that are asked.  For each item the short lists are added up first,
term at a time, into accumulators: one iterator over documents in order, with a
known bound.  It then takes part, like any long list, in a document-at-a-time
search that skips: documents that are on no list that could still lift them
over the worst of the best are never looked at, and a document is dropped as
soon as what is left cannot lift it.  Statistics are those of the whole corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, Window

from .common import bytes_of, hand_back, settle, slices, table

#: Bytes of items that are searched in one pass over the documents.
BLOCK_BYTES = 4 << 20
#: Postings that a task holds at most before it searches them.
HELD = 2_000_000
#: Lists of at most this share of a task's documents are short.
SHORT = 1 / 16
#: Documents in one step of the document-at-a-time search.
STEP = 512

#: ASCII letters in lower case, digits and bytes of longer characters stay.
_TERMS = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128
               else 32 for i in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TERMS).split()


@dataclass
class Corpus:
    """Documents with a term, all their terms, and the documents of each asked term."""

    n_docs: int
    n_terms: int
    df: np.ndarray

    def weights(self) -> np.ndarray:
        return np.array([math.floor(1000 * math.log((2 * self.n_docs + 2) / (2 * d + 1)))
                         for d in self.df.tolist()], np.int64)


class Lists:
    """Postings of the asked terms over some documents, in the order of the documents."""

    def __init__(self, known: dict[bytes, int]):
        self.known = known
        self.clear()

    def clear(self) -> None:
        self.docs = self.held = 0
        self.lengths: list[int] = []
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, texts: list[bytes]) -> None:
        """Counts the terms of further documents."""
        found, sizes = [], []
        asked = self.known.get
        for t in texts:
            words = terms_of(t)
            self.lengths.append(len(words))
            own = [k for k in map(asked, words) if k is not None]
            found += own
            sizes.append(len(own))
        n = len(self.known)
        doc = np.repeat(np.arange(self.docs, self.docs + len(texts)), sizes)
        key, tf = np.unique(doc * n + np.array(found, np.int64), return_counts=True)
        self.docs += len(texts)
        self.held += len(key)
        self.parts.append((key % n, key // n, tf))

    def frequencies(self) -> np.ndarray:
        return sum((np.bincount(t, minlength=len(self.known)) for t, _, _ in self.parts),
                   np.zeros(len(self.known), np.int64))

    def lists(self, corpus: Corpus, weights: np.ndarray) -> "Impacts":
        term, doc, tf = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        order = np.argsort(term, kind="stable")
        term, doc, tf = term[order], doc[order], tf[order].astype(np.int64)
        n = np.array(self.lengths, np.int64)
        m = 10 + 90 * n * corpus.n_docs // max(1, corpus.n_terms)
        impact = weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
        return Impacts(np.searchsorted(term, np.arange(len(self.known) + 1)), doc, impact, self.docs)


@dataclass
class Impacts:
    """Each term's documents in order, and what the term adds to their scores."""

    edges: np.ndarray
    doc: np.ndarray
    impact: np.ndarray
    docs: int

    def of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        own = slice(self.edges[term], self.edges[term + 1])
        return self.doc[own], self.impact[own]


def accumulated(lists: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Term at a time: the documents of all lists in order, with their sums."""
    doc = np.concatenate([d for d, _ in lists])
    impact = np.concatenate([v for _, v in lists])
    order = np.argsort(doc, kind="stable")
    doc, impact = doc[order], impact[order]
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    return doc[first], np.add.reduceat(impact, first)


def looked_up(wanted: np.ndarray, doc: np.ndarray, impact: np.ndarray) -> np.ndarray:
    """What a list adds to `wanted` documents (in order), skipping all others of the list."""
    at = np.searchsorted(doc, wanted)
    at[at == len(doc)] = len(doc) - 1
    return np.where(doc[at] == wanted, impact[at], 0)


def best(lists: list[tuple[np.ndarray, np.ndarray]], docs: int, k: int, ids: np.ndarray,
         floor: int = 0, counted: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The `k` best documents and their scores; ties go to the lesser of `ids`.

    `floor` is a score that `k` documents elsewhere have reached: documents
    under it need not be found.  `counted` is told how many documents were
    looked at.
    """
    lists = [l for l in lists if len(l[0]) and l[1].max() > 0]
    short = [l for l in lists if len(l[0]) <= docs * SHORT]
    runs = [l for l in lists if len(l[0]) > docs * SHORT]
    if short:
        runs.append(accumulated(short))
    bound = np.array([int(v.max()) for _, v in runs], np.int64)
    order = np.argsort(bound, kind="stable")
    runs, bound = [runs[i] for i in order], bound[order]
    below = np.cumsum(bound)
    top_doc, top_score = np.zeros(0, np.int64), np.zeros(0, np.int64)
    worst, at = floor, 0
    while runs:
        # Lists that even together stay under the worst need not be walked, only looked up.
        need = int(np.searchsorted(below, worst, "left"))
        if need == len(runs):
            break
        walked = runs[need:]
        # The next STEP documents of the walked lists; up to `stop` every one of them is there.
        ahead = [d[np.searchsorted(d, at):][:STEP] for d, _ in walked]
        ends = [int(d[-1]) + 1 for d in ahead if len(d) == STEP]
        stop = min(ends) if ends else docs
        at_docs = np.unique(np.concatenate([d[:np.searchsorted(d, stop)] for d in ahead]))
        score = np.zeros(len(at_docs), np.int64)
        if counted is not None:
            counted["seen"] = counted.get("seen", 0) + len(at_docs)
        for i in range(len(runs) - 1, -1, -1):
            # Dropped as soon as all lists that are left cannot lift it to the worst.
            stays = score + below[i] >= max(worst, 1)
            at_docs, score = at_docs[stays], score[stays]
            if not len(at_docs):
                break
            score = score + looked_up(at_docs, *runs[i])
        stays = score >= max(worst, 1)
        top_doc = np.concatenate([top_doc, at_docs[stays]])
        top_score = np.concatenate([top_score, score[stays]])
        if len(top_doc) > k:
            first = np.lexsort((ids[top_doc], -top_score))[:k]
            top_doc, top_score = top_doc[first], top_score[first]
        if len(top_doc) == k:
            worst = max(worst, int(top_score.min()))
        at = stop
        if at >= docs:
            break
    first = np.lexsort((ids[top_doc], -top_score))
    return top_doc[first], top_score[first]


def _asked(items: list[tuple[object, str]]) -> tuple[dict[bytes, int], list[np.ndarray]]:
    known: dict[bytes, int] = {}
    own = [np.array([known.setdefault(w, len(known)) for w in dict.fromkeys(terms_of((t or "").encode()))],
                    np.int64) for _, t in items]
    return known, own


def _corpus(docs: DataFrame, text: str, known: dict[bytes, int]) -> Corpus:
    """One pass over all documents; tasks count, the shuffle adds up."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(known) + 2, np.int64)
        lists = Lists(known)
        for part in parts:
            for piece in slices(part, text):
                lists.add(bytes_of(piece.column(0)))
                df[:-2] += lists.frequencies()
                df[-2] += sum(n > 0 for n in lists.lengths)
                df[-1] += sum(lists.lengths)
                lists.clear()
        met = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(df[met])], ["term", "n"])
        hand_back()

    told = docs.select(text).mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(
        F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(known) + 2, np.int64)
    out[told.column("term").to_numpy()] = told.column("n").to_numpy()
    return Corpus(int(out[-2]), int(out[-1]), out[:-2])


def _ranked(docs: DataFrame, items: list[tuple[object, str]], depth: int, doc_id: str,
            text: str) -> DataFrame:
    """(item, doc_id, score): the best of every task for each item of a block."""
    known, own = _asked(items)
    corpus = _corpus(docs, text, known)
    weights = corpus.weights()
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = Lists(known)
        ids: list[pa.Array] = []
        # Scores that a task's best have already reached, so that later documents skip more.
        floors = [0] * len(items)

        def search() -> pa.RecordBatch:
            impacts = lists.lists(corpus, weights)
            names = pa.chunked_array(ids).combine_chunks()
            # The order of ids, null last, as numbers.
            place = np.empty(len(names), np.int64)
            place[pc.array_sort_indices(names).to_numpy()] = np.arange(len(names))
            item, doc, score = [], [], []
            for i, terms in enumerate(own):
                d, s = best([impacts.of(t) for t in terms.tolist()], impacts.docs, depth, place, floors[i])
                if len(d) == depth:
                    floors[i] = max(floors[i], int(s[-1]))
                item.append(np.full(len(d), i))
                doc.append(d)
                score.append(s)
            lists.clear()
            ids.clear()
            none = np.zeros(0, np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([none, *item])),
                 names.take(pa.array(np.concatenate([none, *doc]))),
                 pa.array(np.concatenate([none, *score]))], ["item", "doc_id", "score"])

        for part in parts:
            for piece in slices(part, text):
                if piece.num_rows:
                    lists.add(bytes_of(piece.column(1)))
                    ids.append(piece.column(0))
                if lists.held > HELD:
                    yield search()
        if ids:
            yield search()
        hand_back()

    return docs.select(doc_id, text).mapInArrow(run, "item bigint, doc_id %s, score bigint" % kind)


def ranked(docs: DataFrame, items: DataFrame, depth: int = 10, doc_id: str = "doc_id",
           text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the `depth` best documents of each item.

    Scores are exact 64-bit integers over whole texts; equal ones are in the
    order of doc_id, a null one last.  Null, empty and termless texts score
    nothing and are no answers, nor do such items have any.  Repeated
    documents are documents of their own.  Item rows
    with equal id and text are one question; rows with one id and different
    texts are answered apart, under that id.  Empty tables give no rows.  Items are searched in blocks of about
    BLOCK_BYTES, two passes over the documents each.
    """
    asked = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).distinct()
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    found = None
    for block in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        rows = [(r["item_id"], r["text"]) for r in own.orderBy("item_id", "text").collect()]
        names = items.sparkSession.createDataFrame(
            [(i, name) for i, (name, _) in enumerate(rows)],
            "item bigint, item_id %s" % items.schema[item_id].dataType.simpleString())
        best_first = Window.partitionBy("item").orderBy(
            F.desc("score"), F.asc_nulls_last("doc_id"))
        part = _ranked(docs, rows, depth, doc_id, text).withColumn(
            "rank", F.row_number().over(best_first)).where(F.col("rank") <= depth).join(
            F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        if blocks > 1:
            part = settle(part)
        found = part if found is None else found.unionByName(part)
    return found


def op13_lexical(spark, sf_dir: str) -> DataFrame:
    """item_id, rank, doc_id, score: the ten best documents of each benchmark item."""
    return ranked(table(spark, sf_dir, "documents").select("doc_id", "text"),
                  table(spark, sf_dir, "benchmark"))
