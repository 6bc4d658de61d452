"""Quality by ordinal regression: cumulative links over shared hashed-text weights.

P(grade <= k) = sigmoid(t_k - w x) with one weight vector w and rising
thresholds t_k, so one direction orders all grades.
"""

from __future__ import annotations

from dataclasses import dataclass
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .common import batches, bytes_of, table

#: Hashed features.
BUCKETS = 1 << 16
#: Rated documents of each grade that the model is fitted on, those of least hash.
FIT_DOCS = 2000
#: Every fifth of them sets the selection threshold instead.
CALIBRATE = 5
STEPS = 120
#: Share of good rated documents that selection keeps.
RECALL = 0.99

_FOLD = bytes(i + 32 if 65 <= i <= 90 else 32 if i < 48 or 57 < i < 65 or 90 < i < 97
              or 122 < i < 128 else i for i in range(256))
#: ASCII punctuation and the classes of letters, counted one by one.
_MARKS = [bytes([c]) for c in range(33, 127) if not chr(c).isalnum()] + [
    bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58)), bytes(range(128, 256))]


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, value) of one whole text: words by their share, shape by steps.

    Word buckets have log counts of unit length.  Shape is a bucket for each
    step of a figure: marks per character, repeated words and lines, length.
    """
    words = text.translate(_FOLD).split()
    hashed = np.fromiter(map(crc32, words), np.uint32, len(words)) % BUCKETS
    bucket, count = np.unique(hashed, return_counts=True)
    value = np.log1p(count).astype(np.float64)
    value /= max(1e-9, np.sqrt((value ** 2).sum()))
    n = max(1, len(text))
    lines = [x for x in text.split(b"\n") if x.strip()]
    shape = [(len(text) - len(text.translate(None, m))) / n for m in _MARKS]
    shape += [len(set(words)) / max(1, len(words)), len(set(lines)) / max(1, len(lines)),
              int(count.max(initial=0)) / max(1, len(words))]
    steps = [int(np.log2(s * 256 + 1) * 2) for s in shape] + [int(np.log2(len(words) + 1))]
    named = np.array([crc32(b"shape %d %d" % (i, s)) % BUCKETS for i, s in enumerate(steps)])
    return (np.concatenate([bucket.astype(np.int64), named]),
            np.concatenate([value, np.full(len(named), 0.3)]))


@dataclass
class Model:
    """Half a megabyte, whatever the corpus."""

    weights: np.ndarray
    thresholds: np.ndarray
    select: float

    def line(self, texts: list[bytes]) -> np.ndarray:
        return np.array([float(self.weights[b] @ v) for b, v in map(features, texts)])

    def above(self, line: np.ndarray) -> np.ndarray:
        """P(grade > k) for every k below the best grade."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - line[:, None], -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], grades: int) -> Model:
    """Weights and thresholds by Adam over all rows; thresholds rise by softplus gaps."""
    if not rows:
        return Model(np.zeros(BUCKETS), np.arange(grades - 1) - 1.0, 0.5)
    bucket = np.concatenate([r[0] for r in rows])
    value = np.concatenate([r[1] for r in rows])
    start = np.concatenate([[0], np.cumsum([len(r[0]) for r in rows])[:-1]])
    doc = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    y = np.array([r[2] for r in rows])
    # Grades weigh alike, however many of each are rated.
    weight = 1 / np.bincount(y, minlength=grades)[y] / len(np.unique(y))
    p = np.zeros(BUCKETS + grades - 1)
    p[BUCKETS] = -1.0
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, STEPS + 1):
        gaps = np.logaddexp(0, p[BUCKETS + 1:]) + 1e-3
        t = p[BUCKETS] + np.concatenate([[0], np.cumsum(gaps)])
        line = np.add.reduceat(p[bucket] * value, start)
        edges = np.concatenate([[-40.0], t, [40.0]])
        s = 1 / (1 + np.exp(-np.clip(edges[None, :] - line[:, None], -40, 40)))
        rows_of = np.arange(len(y))
        high, low = s[rows_of, y + 1], s[rows_of, y]
        chance = np.maximum(high - low, 1e-12)
        up, down = high * (1 - high) / chance, low * (1 - low) / chance
        g = np.zeros_like(p)
        g[:BUCKETS] = np.bincount(bucket, (weight * (up - down))[doc] * value, BUCKETS)
        by = np.zeros(grades + 1)
        np.add.at(by, y + 1, -weight * up)
        np.add.at(by, y, weight * down)
        by = by[1:-1]
        g[BUCKETS] = by.sum()
        tails = np.cumsum(by[::-1])[::-1][1:]
        g[BUCKETS + 1:] = tails / (1 + np.exp(-p[BUCKETS + 1:]))
        g[:BUCKETS] += 1e-5 * p[:BUCKETS]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p -= 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    gaps = np.logaddexp(0, p[BUCKETS + 1:]) + 1e-3
    return Model(p[:BUCKETS].astype(np.float32), p[BUCKETS] + np.concatenate(
        [[0], np.cumsum(gaps)]), 0.5)


def held_out(doc_id: Column) -> Column:
    """Rows whose ratings are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, ratings: DataFrame, grades: int, good: int = 1) -> Model:
    """A model from `ratings` (doc_id, grade 0 to grades - 1) that are not held out.

    At most FIT_DOCS documents of a grade are fitted; only their hashed
    features reach the driver.  The selection threshold on P(grade >= good) is
    the highest, one half at most, that keeps RECALL of the good documents set
    aside.  Null grades and ids teach nothing.  Of several ratings of a
    document the highest counts.
    """
    known = ratings.where(F.col("doc_id").isNotNull() & F.col("grade").between(0, grades - 1)
                          & ~held_out(F.col("doc_id"))).groupBy(
        F.col("doc_id").alias("_id")).agg(F.max("grade").alias("_grade"))
    picked = None
    for grade in range(grades):
        own = known.where(F.col("_grade") == grade).orderBy(F.xxhash64("_id"), "_id").limit(FIT_DOCS)
        picked = own if picked is None else picked.unionByName(own)
    rated = docs.select("doc_id", "text").join(picked, F.col("doc_id") == F.col("_id")).select(
        "doc_id", "text", "_grade")

    def work(columns: dict) -> dict:
        made = [features(t) for t in bytes_of(columns["text"])]
        return {"doc_id": columns["doc_id"], "grade": columns["_grade"],
                "bucket": [b for b, _ in made], "value": [v for _, v in made]}

    kind = docs.schema["doc_id"].dataType.simpleString()
    told = batches(rated, work, "doc_id %s, grade int, bucket array<bigint>, value array<double>"
                   % kind, text="text").orderBy("doc_id", "grade").collect()
    rows = [(np.array(r["bucket"], np.int64), np.array(r["value"]), r["grade"]) for r in told]
    model = fit([r for i, r in enumerate(rows) if i % CALIBRATE], grades)
    aside = [r for i, r in enumerate(rows) if i % CALIBRATE == 0 and r[2] >= good]
    if aside:
        line = np.array([float(model.weights[b] @ v) for b, v, _ in aside])
        model.select = float(min(0.5, np.quantile(model.above(line)[:, good - 1], 1 - RECALL)))
    return model


def grade(docs: DataFrame, model: Model, good: int = 1, doc_id: str = "doc_id",
          text: str = "text") -> DataFrame:
    """(doc_id, expected_grade, tail_probability, kept) of every whole text.

    `tail_probability` is P(grade >= good).  Null and empty texts are graded
    by their shape alone.  Repeated rows get the same grade; no rows, no rows.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def work(columns: dict) -> dict:
        above = model.above(model.line(bytes_of(columns[text])))
        return {"doc_id": columns[doc_id], "expected": above.sum(axis=1),
                "tail": above[:, good - 1], "kept": above[:, good - 1] >= model.select}

    return batches(docs.select(doc_id, text), work, "doc_id %s, expected_grade double, "
                   "tail_probability double, kept boolean" % kind, text=text)


def ratings_of(labels: DataFrame) -> DataFrame:
    """Grades from the two labels: 0 poor, 1 good text that is toxic, 2 good."""
    return labels.select("doc_id", F.when(F.col("quality") == 0, 0).when(
        (F.col("quality") == 1) & (F.col("toxic") == 1), 1).when(
        F.col("quality") == 1, 2).alias("grade"))


def op5_ordinal(spark, sf_dir: str) -> DataFrame:
    """Expected grade, tail probability and selection of every document."""
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, ratings_of(table(spark, sf_dir, "labels")), 3)
    return grade(docs, model)
