"""Toxicity by compression distance.

Two zstandard dictionaries are learnt, one from toxic and one from ordinary
text.  A window that the toxic dictionary compresses to fewer bytes than the
ordinary one is toxic evidence.  A threshold on that gain and the weights that
turn a document's evidence into a probability are calibrated on labelled
documents that neither dictionary has seen.  The contents of the dictionaries
are chosen here, by class frequency: the library's own trainer keeps what is
frequent in either class and drops rare telling words.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import repeat
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .common import batches, bytes_of, table

#: Labelled documents of each class that a model is fitted on, those of least hash; of
#: these, longer ones are left to the other documents.  Both bound the fit, not the scoring.
FIT_DOCS = 2500
FIT_BYTES = 40_000
#: Every fourth fitted document calibrates and is kept from the dictionaries.
CALIBRATE = 4
#: Distinct words of a dictionary: frequent words of ordinary text, passages of toxic text.
ORDINARY_WORDS, TOXIC_WORDS = 4000, 2000
#: Longest window in bytes; a longer run of characters is cut into windows that overlap by half.
WINDOW = 48
LEVEL = 12
#: Bytes of a compressed window that are frame and headers.
FRAME = 10
#: Windows that a task remembers the gains of before it starts again; gains are kept in
#: hundredths, which cost no memory beside the window.
REMEMBERED = 400_000

#: A-Z to a-z; ASCII punctuation ends a window.
_FOLD = bytes(i + 32 if 65 <= i <= 90 else 32 if i < 48 or 57 < i < 65 or 90 < i < 97
              or 122 < i < 128 else i for i in range(256))


def _codes() -> np.ndarray:
    """Four mixed bytes for each pair of neighbouring bytes."""
    x = (np.arange(1 << 16, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(31)
    return (x * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)).astype("<u4")


_CODES = _codes()


def spread(window: bytes) -> bytes:
    """The window as the compressors see it: four bytes for each pair of neighbours.

    A match costs zstandard about three bytes, as much as a short word itself.
    Written like this, what both dictionaries lack costs four bytes a
    character, and what one of them holds costs three in all.
    """
    units = np.frombuffer(b" " + window + b" ", np.uint8).astype(np.int64)
    return _CODES[units[:-1] * 256 + units[1:]].tobytes()


def windows(text: bytes) -> list[bytes]:
    """The words of the text, folded; runs over WINDOW bytes in overlapping parts."""
    words = text.translate(_FOLD).split()
    if len(text) <= WINDOW or max(map(len, words), default=0) <= WINDOW:
        return words
    return [w[i:i + WINDOW] for w in words
            for i in range(0, max(1, len(w) - WINDOW // 2), WINDOW // 2)]


@dataclass
class Model:
    """What a task needs: under half a megabyte, whatever the corpus."""

    toxic: bytes
    ordinary: bytes
    gain: float
    weights: list[float]
    #: Score where nothing could be learnt.
    prior: float

    def scorer(self) -> "Scorer":
        return Scorer(self)


class Scorer:
    """Gains of windows, each distinct one compressed once per task."""

    def __init__(self, model: Model):
        import zstandard as z

        self.model = model
        self.compress = []
        for data in (model.ordinary, model.toxic):
            known = z.ZstdCompressionDict(data, dict_type=z.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=LEVEL)
            self.compress.append(z.ZstdCompressor(
                level=LEVEL, dict_data=known, write_content_size=False,
                write_dict_id=False).compress)
        self.gains: dict[bytes, int] = {}

    def gains_of(self, found: list[bytes]) -> np.ndarray:
        """The share of a window's bytes that the toxic dictionary saves, 0 if none, per window."""
        if len(self.gains) > REMEMBERED:
            self.gains = {}
        known, (ordinary, toxic) = self.gains, self.compress
        values = np.fromiter(map(known.get, found, repeat(-1)), np.int16, len(found))
        for i in np.flatnonzero(values < 0):
            w = found[i]
            if w not in known:
                wide = spread(w)
                n = len(ordinary(wide))
                known[w] = max(0, round(100 * (n - len(toxic(wide))) / max(6, n - FRAME)))
            values[i] = known[w]
        return values / np.float32(100)

    def evidence(self, texts: Iterable[bytes]) -> np.ndarray:
        """Per text: whether any window gains enough, how many (log), their share, best gain."""
        parts = [windows(t) for t in texts]
        gains = self.gains_of([w for p in parts for w in p])
        out = np.zeros((len(parts), 4))
        begin = 0
        for row, part in enumerate(parts):
            own = gains[begin:begin + len(part)]
            begin += len(part)
            if len(part):
                n = int((own >= self.model.gain).sum())
                out[row] = n > 0, math.log1p(n), n / math.sqrt(len(part)), max(0.0, own.max())
        return out

    def scores(self, texts: Iterable[bytes]) -> np.ndarray:
        """Probabilities; without a model all have the prior."""
        texts = list(texts)
        if not self.model.weights:
            return np.full(len(texts), self.model.prior)
        x = self.evidence(texts) @ np.array(self.model.weights[1:]) + self.model.weights[0]
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def strings(words: Iterable[bytes]) -> set[bytes]:
    """Strings of 5 to 8 bytes in the words, with the space on both sides."""
    found = set()
    for w in words:
        spaced = b" " + w + b" "
        for n in (5, 6, 7, 8):
            found.update(spaced[i:i + n] for i in range(len(spaced) - n + 1))
    return found


def telling(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> set[bytes]:
    """Character strings that clearly more of the toxic documents have.

    A string counts once per document; it must be 20 times as frequent among
    toxic documents, with a likelihood ratio that chance does not reach among
    the many strings there are.
    """
    here: Counter = Counter()
    for words in toxic:
        here.update(strings(set(words)))
    least = max(3, len(toxic) // 200)
    here = Counter({s: n for s, n in here.items() if n >= least})
    there: Counter = Counter()
    for words in ordinary:
        there.update(strings(set(words)) & here.keys())
    a, b = len(toxic), len(ordinary)
    return {s for s, n in here.items()
            if n / a > 20 * (there[s] + 0.5) / b
            and n * math.log(n / a / ((n + there[s] + 0.5) / (a + b))) > 10}


def unlike(docs: list[list[bytes]]) -> list[list[bytes]]:
    """Documents without near copies: what fills a copied document is no mark of a class.

    Four minima over hashed three-word shingles; one that an earlier document
    has means a copy.
    """
    seen: set[tuple[int, int]] = set()
    out = []
    for words in docs:
        hashes = [crc32(b" ".join(words[i:i + 3])) for i in range(max(1, len(words) - 2))]
        own = {(h & 3, min(x for x in hashes if x & 3 == h & 3)) for h in set(
            x & 3 for x in hashes)}
        if not own & seen:
            out.append(words)
        seen |= own
    return out


def fit(rows: list[tuple[bytes, int]]) -> Model:
    """A model from (text, label) rows of both classes; with one class alone, a fixed score."""
    split = [[t for t, y in rows if y == label] for label in (1, 0)]
    if not all(split):
        return Model(b" ", b" ", 1.0, [], 0.9 if split[0] else 0.05)
    same: dict[bytes, bytes] = {}  # one object per distinct word
    learn = [[[same.setdefault(w, w) for w in windows(t)] for i, t in enumerate(own)
              if i % CALIBRATE or len(own) < CALIBRATE] for own in split]
    toxic, ordinary = unlike(learn[0]), unlike(learn[1])
    marks = telling(toxic, ordinary)
    passages: Counter = Counter()
    for words in toxic:
        passages.update(w for w in set(words) if not marks.isdisjoint(strings([w])))
    common: Counter = Counter()
    for words in ordinary:
        common.update(set(words) - passages.keys())
    # Zstandard reaches the end of a dictionary at the least cost: the most frequent go there.
    # Both classes hold ordinary words; the toxic dictionary has the toxic passages besides.
    base = b"".join(spread(w) for w in reversed(best_of(common, ORDINARY_WORDS)))
    own = b"".join(spread(w) for w in reversed(best_of(passages, TOXIC_WORDS)))
    model = Model(own + base, base or b" ", 1.0, [], 0.5)
    held = [[t for i, t in enumerate(own) if i % CALIBRATE == 0] for own in split]
    model.gain = threshold(model, *held)
    weights(model, *held)
    return model


def best_of(counts: Counter, n: int) -> list[bytes]:
    """The n most frequent words, ties by the word."""
    return sorted(counts, key=lambda w: (-counts[w], w))[:n]


def threshold(model: Model, toxic: list[bytes], ordinary: list[bytes]) -> float:
    """The gain that best tells held-back documents apart by having a window with it."""
    scorer = Scorer(model)
    best = [np.array([scorer.gains_of(windows(t)).max(initial=-1) for t in own])
            for own in (toxic, ordinary)]
    steps = np.arange(0.2, 0.9, 0.025)
    apart = [(best[0] >= g).mean() - (best[1] >= g).mean() for g in steps]
    return float(steps[int(np.argmax(np.round(apart, 6)))])


def weights(model: Model, toxic: list[bytes], ordinary: list[bytes]) -> None:
    """Logistic weights of the evidence, by Newton steps with a small ridge."""
    scorer = Scorer(model)
    x = np.vstack([scorer.evidence(toxic), scorer.evidence(ordinary)])
    x = np.hstack([np.ones((len(x), 1)), x])
    y = np.array([1.0] * len(toxic) + [0.0] * len(ordinary))
    ridge = np.diag([1e-6, 0.2, 0.2, 0.2, 0.2])
    w = np.zeros(5)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(5),
                               x.T @ (y - p) - ridge @ w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    model.weights = w.tolist()


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from; a null doc_id is one of the others."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from labelled documents that are not held out: at most FIT_DOCS of a class.

    The sample is the labelled documents of least hash, so it is the same on
    every run.  Null texts, labels and ids teach nothing.
    """
    known = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").alias("_toxic")).where(
        F.col("_id").isNotNull() & F.col("_toxic").isin(0, 1) & ~held_out(F.col("_id")))
    picked = [known.where(F.col("_toxic") == y).groupBy("_id").agg(F.max("_toxic").alias("_toxic"))
              .orderBy(F.xxhash64("_id"), "_id").limit(FIT_DOCS) for y in (1, 0)]
    rows = docs.where(F.octet_length("text") <= FIT_BYTES).select("doc_id", "text").join(
        picked[0].unionByName(picked[1]), F.col("doc_id") == F.col("_id")).select(
        "doc_id", "text", "_toxic").orderBy("doc_id", "text")
    return fit([(r["text"].encode(), r["_toxic"]) for r in rows.collect()])


def toxicity(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text",
             ) -> DataFrame:
    """(doc_id, score): the probability that each whole text is toxic.

    Null and empty texts have no evidence and get the lowest score of the
    model.  Every row is scored, repeated ones alike; nothing but the text
    counts.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def work(columns: dict, scorer: Scorer) -> dict:
        return {"doc_id": columns[doc_id], "score": scorer.scores(bytes_of(columns[text]))}

    return batches(docs.select(doc_id, text), work, "doc_id %s, score double" % kind,
                   model.scorer, text)


def scored(docs: DataFrame, model: Model, text: str = "text", score: str = "_score") -> DataFrame:
    """`docs` with all its columns and the score of each row; see `toxicity`."""
    kept = [c for c in docs.columns if c != score]
    ddl = ", ".join("`%s` %s" % (c.replace("`", "``"), docs.schema[c].dataType.simpleString())
                    for c in kept)

    def work(columns: dict, scorer: Scorer) -> dict:
        return {**{c: columns[c] for c in kept}, score: scorer.scores(bytes_of(columns[text]))}

    return batches(docs.select(*kept), work, "%s, `%s` double" % (ddl, score), model.scorer, text)


def op2_toxicity(spark, sf_dir: str, rejected: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, table(spark, sf_dir, "labels"))
    return toxicity(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= rejected).cast("int").alias("predicted"))
