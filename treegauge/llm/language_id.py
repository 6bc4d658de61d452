"""Language identification by cross-parsing entropy over suffix automata.

A text is parsed greedily into phrases, each the longest match with anything in
a language's labelled text; the suffix automaton of that text yields the
matches.  A language explains a text well if it needs few phrases.  Phrases are
normalised by what one costs, the logarithm of the labelled text's length: the
language with the least bits per byte wins.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window

from .common import batches, table, texts_of

#: Bytes of labelled text that all languages together keep, and at most one of them.
FIT_BYTES, OWN_BYTES = 1 << 17, 1 << 15
#: Characters taken of one labelled text, so that many texts have a part in a language.
PIECE = 256
#: Languages that are learnt at most, the most frequent ones.
LANGUAGES = FIT_BYTES // PIECE
#: A text is parsed in sections of about so many bytes, cut at spaces, all at the same time.
SECTION = 1024
#: Scores: phrases follow on each other, so their bits count for less than independent ones.
TEMPER = 0.05

#: ASCII letters in lower case and bytes of longer characters stay, the rest parts words.
_WORDS = bytes(i + 32 if 65 <= i <= 90 else i if 97 <= i <= 122 or i >= 128 else 32
               for i in range(256))


def normalised(text: str) -> bytes:
    """Lower-case UTF-8 words between single spaces, one at either end."""
    return b" %s " % b" ".join(text.lower().encode().translate(_WORDS).split())


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """The transitions of each state; state 0 reads exactly the substrings of `text`."""
    step: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in text:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return step


@dataclass(frozen=True)
class Model:
    """Labelled text of each language, in the order of their names."""

    langs: tuple[str, ...]
    texts: tuple[bytes, ...]


class Parser:
    """All automata as one table of moves, read by every section of every text at once.

    An entry holds the next state and how many phrases the byte ends: none
    where the match goes on; one where it ends before the byte; one more for a
    byte the language has nowhere, a phrase of its own.
    """

    def __init__(self, model: Model):
        used = sorted(set(b"".join(model.texts)))
        self.code = np.zeros(256, np.int64)
        self.code[used] = np.arange(1, len(used) + 1)
        self.width = len(used) + 1
        self.langs = model.langs
        tables, roots = [], []
        below = 0
        for text in model.texts:
            step = suffix_automaton(text)
            own = np.zeros((len(step), self.width), np.int64)
            first = np.zeros(self.width, np.int64)
            for c, to in step[0].items():
                first[self.code[c]] = to
            known = first > 0
            # A match that ends: its phrase, and a phrase for a byte without any match.
            own[:] = (first + below) << 2 | np.where(known, 1, 2)
            own[0] = (first + below) << 2 | np.where(known, 0, 1)
            at = [(s, c, to) for s, moves in enumerate(step) for c, to in moves.items()]
            s, c, to = np.array(at, np.int64).reshape(-1, 3).T
            own[s, self.code[c]] = (to + below) << 2
            tables.append(own.astype(np.int32))
            roots.append(below)
            below += len(step)
        self.moves = np.concatenate(tables).ravel()
        self.roots = np.array(roots, np.int64)
        #: Bits of one phrase: where in the labelled text it stands.
        self.bits = np.log2([max(2, len(t)) for t in model.texts])

    def phrases(self, sections: list[bytes]) -> np.ndarray:
        """Phrases of each section (rows) in each language (columns)."""
        sizes = np.array([len(s) for s in sections], np.int64)
        order = np.argsort(-sizes, kind="stable")
        flat = self.code[np.frombuffer(b"".join(sections), np.uint8)]
        starts = (np.cumsum(sizes) - sizes)[order]
        sizes = sizes[order]
        state = np.tile(self.roots, (len(sections), 1))
        counts = np.zeros(state.shape, np.int64)
        # Sections still being read: the longest first, so always a first part of all.
        active = np.searchsorted(-sizes, -np.arange(int(sizes[0]) if len(sizes) else 0), "left")
        for k, n in enumerate(active.tolist()):
            moved = self.moves[state[:n] * self.width + flat[starts[:n] + k, None]]
            counts[:n] += moved & 3
            state[:n] = moved >> 2
        counts += state != self.roots
        out = np.empty_like(counts)
        out[order] = counts
        return out

    def entropies(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text in each language."""
        sections: list[bytes] = []
        edges = [0]
        for t in texts:
            sections += cut(t)
            edges.append(len(sections))
        sums = np.zeros((len(sections) + 1, len(self.langs)), np.int64)
        np.cumsum(self.phrases(sections), axis=0, out=sums[1:])
        at = np.array(edges)
        return (sums[at[1:]] - sums[at[:-1]]) * self.bits


def cut(text: bytes) -> list[bytes]:
    """The text in sections that end before a space; an endless word is cut where it stands."""
    out = []
    at = 0
    while len(text) - at > 2 * SECTION:
        stop = text.rfind(b" ", at + 1, at + SECTION)
        stop = stop if stop > at else at + SECTION
        out.append(text[at:stop])
        at = stop
    return [*out, text[at:]]


_PARSERS: dict[Model, Parser] = {}


def parser(model: Model) -> Parser:
    """Built once per worker."""
    if model not in _PARSERS:
        _PARSERS.clear()
        _PARSERS[model] = Parser(model)
    return _PARSERS[model]


def held_out(doc_id: Column) -> Column:
    """Rows that are never learnt from; a null doc_id is one of the others."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Labelled text of each language: pieces of PIECE characters of the texts of least hash.

    All languages together keep FIT_BYTES, each the same and OWN_BYTES at
    most, whatever the number of rows; of more than LANGUAGES the rarest are not learnt.  Copies of a text count once.  The
    piece of a text begins where its hash says, so that openings all alike do
    not stand for a language.  Null texts and languages teach nothing; without
    a labelled text the model knows no language.
    """
    begin = F.pmod(F.xxhash64(text), F.greatest(F.lit(1), F.length(text) - PIECE)) + 1
    known = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()
                       & (F.length(text) > 0)).select(
        F.col(lang).cast("string").alias("lang"), F.xxhash64(text).alias("h"),
        F.substring(F.col(text), begin.cast("int"), F.lit(PIECE)).alias("piece"))
    sizes = known.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).orderBy(
        F.desc("n"), "lang").limit(LANGUAGES).collect()
    share = min(OWN_BYTES, FIT_BYTES // max(1, len(sizes)))
    wanted = max(1, share // PIECE)
    # Twice what is wanted lies under the bound on average, so that hardly a language has less.
    rank = F.shiftrightunsigned("h", 1) / F.lit(float(1 << 63))
    bounds = F.broadcast(docs.sparkSession.createDataFrame(
        [(r["lang"], (2.0 * wanted + 8) / r["n"]) for r in sizes], "lang string, bound double"))
    near = known.join(bounds, "lang").where(rank <= F.col("bound")).select("lang", "h", "piece")
    order = Window.partitionBy("lang").orderBy("h", "piece")
    rows = near.dropDuplicates(["lang", "h"]).withColumn("k", F.row_number().over(order)).where(
        F.col("k") <= wanted).orderBy("lang", "k").select("lang", "piece").collect()
    texts: dict[str, bytes] = {}
    for r in rows:
        texts[r["lang"]] = texts.get(r["lang"], b"") + normalised(r["piece"])
    return Model(tuple(texts), tuple(t[:share] for t in texts.values()))


def identified(docs: DataFrame, model: Model, doc_id: str = "doc_id",
               text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, bits_per_byte) of each whole text.

    `und`, 0 and null where the text is null or holds no letter, or the model
    knows no language.  Ties go to the language first by name.  `score` is the
    share of the winner where each bit more makes a language less likely.
    Repeated rows repeat; no rows give none; other columns are left out.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    ddl = "doc_id %s, lang_pred string, score double, bits_per_byte double" % kind

    def work(columns: dict) -> dict:
        texts = texts_of(columns[text])
        n = len(texts)
        pred, score = np.full(n, "und", object), np.zeros(n)
        per_byte = np.full(n, np.nan)
        own = [i for i, t in enumerate(texts) if any(map(str.isalpha, t))] if model.langs else []
        if own:
            read = parser(model)
            words = [normalised(texts[i]) for i in own]
            bits = read.entropies(words)
            least = bits.min(axis=1)
            odds = np.exp2(-TEMPER * (bits - least[:, None])).sum(axis=1)
            pred[own] = np.array(read.langs, object)[bits.argmin(axis=1)]
            score[own] = 1.0 / odds
            per_byte[own] = least / np.array([len(w) for w in words])
        return {"doc_id": columns[doc_id], "lang_pred": pred.tolist(), "score": score,
                "bits_per_byte": pa.array(per_byte, mask=np.isnan(per_byte))}

    return batches(docs.select(doc_id, text), work, ddl, text=text)


def op11_language_id(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = learn(docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))))
    return identified(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
