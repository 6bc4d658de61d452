"""Quality rules as a short-circuit cascade.

Every rule rejects or passes one document.  On a sample, each rule is timed and
its rejections are counted; the cascade then runs the rule with the most
rejections per second first, of what the ones before it leave over.  A
document meets rules only until one rejects it, so the order changes what the
cascade costs and never what it keeps.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame

from .common import batches, bytes_of, table

#: Documents that costs and selectivities are estimated on.
SAMPLE = 2000

_SPACE = b" \t\n\v\f\r"
_SYMBOLS = b"#*$%&|<>"
_LETTERS = bytes(c for c in range(256) if chr(c).isascii() and chr(c).isalpha() or c >= 128)
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))


def _count(text: bytes, of: bytes) -> int:
    return len(text) - len(text.translate(None, of))


class Document:
    """One text and what rules ask of it, worked out when first asked for."""

    def __init__(self, text: bytes):
        self.text = text

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.split()  # ASCII white space: \\x20 and \\x09-\\x0D

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text.translate(None, _SPACE).decode("utf-8", "replace"))

    @cached_property
    def n_symbols(self) -> int:
        return _count(self.text, _SYMBOLS)

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.text.split(b"\n") if x.strip(_SPACE)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def numbers(self) -> np.ndarray:
        """Words as numbers, equal where the words are."""
        known = {w: i for i, w in enumerate(dict.fromkeys(self.words))}
        return np.fromiter(map(known.__getitem__, self.words), np.int64, self.n_words)

    @cached_property
    def n_repeat_words(self) -> int:
        return repeated_words(self.numbers, 8)

    @cached_property
    def most_of_a_word(self) -> int:
        return int(np.bincount(self.numbers).max()) if self.n_words else 0

    @property
    def base_failed(self) -> bool:
        return self.n_words < 20 or 100 * self.n_repeat_words > 30 * self.n_words


def repeated_words(numbers: np.ndarray, width: int) -> int:
    """Words inside windows of `width` that occur at least twice, the first ones included."""
    n = len(numbers) - width + 1
    if n < 2:
        return 0
    units = numbers.astype(np.uint64)
    mixed = np.zeros(n, np.uint64)
    for i in range(width):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + (units[i:i + n] + np.uint64(1))
    _, first, group, count = np.unique(mixed, return_index=True, return_inverse=True,
                                       return_counts=True)
    again = np.flatnonzero(count[group] > 1)
    if not len(again):
        return 0
    rows = np.lib.stride_tricks.sliding_window_view(numbers, width)
    # Equal hashes must be equal windows; else the windows themselves are compared.
    if any((numbers[again + i] != numbers[first[group[again]] + i]).any() for i in range(width)):
        _, group, count = np.unique(rows[again], axis=0, return_inverse=True, return_counts=True)
        again = again[count[group.ravel()] > 1]
    edge = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + width, -1)
    return int((np.cumsum(edge) > 0).sum())


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Document], bool]


#: Rules beyond the base.  Ratios are wide of ordinary text in any of its languages.
RULES = (
    Rule("symbols", lambda d: 10 * d.n_symbols > 3 * d.n_words),
    Rule("repeated_lines", lambda d: 100 * d.n_dup_lines > 30 * len(d.lines)),
    Rule("word_length", lambda d: not 2 * d.n_words <= d.word_chars <= 20 * d.n_words),
    Rule("letters", lambda d: 2 * _count(d.text, _LETTERS) < len(d.text)),
    Rule("shouting", lambda d: _count(d.text, _UPPER) > _count(d.text, _LOWER)),
    Rule("exclaiming", lambda d: 5 * d.text.count(b"!") > d.n_words),
    Rule("one_word", lambda d: 10 * d.most_of_a_word > 4 * d.n_words),
)


@dataclass(frozen=True)
class Estimate:
    """A rule on the sample: its seconds and the sampled documents it rejects."""

    rule: Rule
    seconds: float
    rejected: frozenset[int]


def estimate(docs: DataFrame, rules: tuple[Rule, ...], sample: int = SAMPLE,
             text: str = "text") -> list[Estimate]:
    """Cost and rejections of every rule on about `sample` documents.

    Only a bit mask per sampled document and the summed seconds leave the
    tasks.  An empty table has no costs.
    """
    rows = docs.count()
    share = docs.select(text).sample(fraction=min(1.0, sample / max(1, rows)), seed=42)

    def work(columns: dict) -> dict:
        out: dict[str, list] = {"mask": [], "seconds": []}
        for t in bytes_of(columns[text]):
            mask, spent = 0, []
            for i, rule in enumerate(rules):
                doc = Document(t)  # anew: a rule pays for what it needs
                began = time.perf_counter()
                mask |= rule.rejects(doc) << i
                spent.append(time.perf_counter() - began)
            out["mask"].append(mask)
            out["seconds"].append(spent)
        return out

    told = batches(share, work, "mask bigint, seconds array<double>", text=text).toPandas()
    masks = told["mask"].tolist()
    return [Estimate(rule, float(sum(s[i] for s in told["seconds"])),
                     frozenset(n for n, m in enumerate(masks) if m >> i & 1))
            for i, rule in enumerate(rules)]


def ordered(found: list[Estimate]) -> tuple[Rule, ...]:
    """Greedily the rule with the most rejections per second among documents left over.

    Rules that reject nothing more come last, the cheapest first.
    """
    left, gone, out = list(found), frozenset(), []
    while left:
        best = max(left, key=lambda e: (len(e.rejected - gone) / max(e.seconds, 1e-9),
                                        -e.seconds))
        left.remove(best)
        gone |= best.rejected
        out.append(best.rule)
    return tuple(out)


def cascade(docs: DataFrame, rules: tuple[Rule, ...], doc_id: str = "doc_id",
            text: str = "text") -> DataFrame:
    """Base figures of every whole text, `kept`, and the rule that rejected first (`failed`).

    `rules` run in their order behind the base rule and stop at the first
    rejection.  A null text has no words and fails the base, as an empty one
    does.  Repeated rows are judged alike; no rows give no rows.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def work(columns: dict) -> dict:
        rows = []
        for t in bytes_of(columns[text]):
            d = Document(t)
            failed = "base" if d.base_failed else next(
                (r.name for r in rules if r.rejects(d)), None)
            rows.append((d.n_words, d.word_chars, d.n_symbols, d.n_dup_lines, d.n_repeat_words,
                         d.base_failed, failed is None, failed))
        cols = list(zip(*rows, strict=True)) or [()] * 8
        return {"doc_id": columns[doc_id], **dict(enumerate(map(list, cols)))}

    return batches(docs.select(doc_id, text), work, "doc_id %s, n_words bigint, word_chars bigint, "
                   "n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
                   "base_failed boolean, kept boolean, failed string" % kind, text=text)


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Figures and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # Which rule rejected first follows the measured order; that it is rejected does not.
    return cascade(docs, ordered(estimate(docs, RULES))).drop("failed")
