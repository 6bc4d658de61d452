"""Secret scans: three base patterns, and a character convolutional network over candidates.

Every base finding and every long run of key characters with letters and
digits is a candidate.  The network reads a candidate in pieces, from its first
character to its last, each with the characters around it, and the likeliest
piece decides.  It is trained on findings of the base patterns in all
documents, rewritten in other alphabets as well, against all candidates and
words that are plainly something else: they are dealt into parts, every part is
gone through whole, and the next round starts from the mean of the parts'
networks.  The threshold keeps the recall it was asked for on what was set
aside of every finding.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import batches, hand_back, settle, table, texts_of

#: Documents and bytes whose pieces are about one part of the training; there are as many parts as all need.
FIT_DOCS, FIT_BYTES = 8_000, 32 << 20
#: Pieces of a kind that a part has at least, where there are that many: scarce ones go to several parts.
SCARCE = 64
#: Share of set-aside findings that the threshold keeps, and the steps it is found in.
RECALL, STEPS = 0.98, 1 << 16
#: Characters before, inside and after a piece of a candidate that the network reads.
BEFORE, INSIDE, AFTER = 24, 40, 16
LENGTH = BEFORE + INSIDE + AFTER
WIDTH, FILTERS, HIDDEN = 5, 16, 16
#: Times that all pieces are gone through: few for full parts, more until parts have made so many steps.
ROUNDS, MOST_ROUNDS, FIT_STEPS = 2, 8, 360
#: Findings, runs and words in a batch, and their shares of its loss.
BATCH, LOSS = (40, 24, 192), (0.5, 0.25, 0.25)
#: Parts' networks are summed as whole numbers of this, so that their order does not matter.
UNIT = 1 / (1 << 32)

#: Fixed patterns of the base findings.
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.A | re.I)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "network")
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

_KEY = "A-Za-z0-9+/_.=-"
_RUN = re.compile(r"(?<![%s])[%s]{16,}+" % (_KEY, _KEY))
_DIGIT = re.compile(r"[0-9]")
_LETTER = re.compile(r"[A-Za-z]")
_OTHER = re.compile(r"\.|[a-z]{5}")
#: Letters of a long word, at least.
LONG = 12
#: What an example is: a finding, a run of key characters that is none, a long word.
FINDING, RUN, WORD = 0, 1, 2


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base findings by start, then kind; code points."""
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates(text: str) -> list[tuple[int, int]]:
    """Runs of at least 16 key characters with a letter and a digit, trailing dots cut."""
    if not _DIGIT.search(text):
        return []
    found = []
    for m in _RUN.finditer(text):
        run = m.group().rstrip(".=-") if m.group().endswith((".", "-")) else m.group()
        if len(run) >= 16 and _DIGIT.search(run) and _LETTER.search(run):
            found.append((m.start(), m.start() + len(run)))
    return found


@cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter: `[^\\W\\d_]`."""
    return np.array([c.isalnum() and not c.isdecimal() for c in map(chr, range(0x110000))], np.int8)


def long_words(text: str) -> list[tuple[int, int]]:
    """Runs of at least LONG letters, whole."""
    if not text:
        return []
    letter = _letters()[np.frombuffer(text.encode("utf-32-le"), "<u4")]
    turns = np.flatnonzero(np.diff(letter, prepend=0, append=0))
    starts, ends = turns[::2], turns[1::2]
    own = ends - starts >= LONG
    return list(zip(starts[own].tolist(), ends[own].tolist(), strict=True))


def pieces(start: int, end: int) -> list[tuple[int, int]]:
    """A candidate in pieces of INSIDE characters; the last one ends where the candidate ends."""
    if end - start <= INSIDE:
        return [(start, end)]
    return [(i, i + INSIDE) for i in range(start, end - INSIDE, INSIDE)] + [(end - INSIDE, end)]


def window(text: str, start: int, end: int) -> str:
    """LENGTH characters: a piece and what stands around it, NUL beyond the text."""
    return text[max(0, start - BEFORE):start].rjust(BEFORE, "\0") + text[start:end].ljust(INSIDE, "\0") + (
        text[end:end + AFTER].ljust(AFTER, "\0"))


def encoded(windows: list[str]) -> np.ndarray:
    """Character numbers; inside the candidate from another range than around it."""
    flat = np.frombuffer("".join(windows).encode("utf-32-le"), "<u4").reshape(-1, LENGTH)
    codes = np.where(flat < 128, flat, 1).astype(np.uint8)
    codes[:, BEFORE:BEFORE + INSIDE] += 128
    return codes


@dataclass
class Network:
    """Convolution, greatest and mean response per filter, one hidden layer; 100 kB."""

    kernel: np.ndarray
    bias: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    threshold: float = 1.0

    @staticmethod
    def start() -> "Network":
        rng = np.random.default_rng(42)
        return Network(rng.normal(0, 0.3, (WIDTH, 256, FILTERS)), np.zeros(FILTERS),
                       rng.normal(0, 0.3, (2 * FILTERS, HIDDEN)), np.zeros(HIDDEN),
                       rng.normal(0, 0.3, HIDDEN), np.zeros(1))

    def parts(self) -> list[np.ndarray]:
        return [self.kernel, self.bias, self.hidden, self.hidden_bias, self.out, self.out_bias]

    def forward(self, codes: np.ndarray) -> tuple:
        places = LENGTH - WIDTH + 1
        codes, kernel = codes.astype(np.intp), self.kernel.astype(np.float32)
        z = np.take(kernel[0], codes[:, :places], axis=0)
        more = np.empty_like(z)
        for k in range(1, WIDTH):
            z += np.take(kernel[k], codes[:, k:k + places], axis=0, out=more, mode="clip")
        z += self.bias.astype(np.float32)
        a = np.maximum(z, 0)
        best = a.argmax(axis=1)
        pooled = np.concatenate([np.take_along_axis(a, best[:, None], 1)[:, 0], a.mean(axis=1)], 1)
        h = np.tanh(pooled @ self.hidden + self.hidden_bias)
        p = 1 / (1 + np.exp(-np.clip(h @ self.out + self.out_bias, -30, 30)))
        return z, a, best, pooled, h, p

    def scores(self, windows: list[str]) -> np.ndarray:
        """Probabilities that the candidates are secrets, in blocks of bounded size."""
        return self.chances(encoded(windows))

    def chances(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(0), *[self.forward(codes[i:i + 512])[-1] for i in range(0, len(codes), 512)]])

    def gradients(self, codes: np.ndarray, y: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
        z, a, best, pooled, h, p = self.forward(codes)
        n, places = len(y), a.shape[1]
        d = (p - y) * weights
        dh = d[:, None] * self.out * (1 - h * h)
        dp = dh @ self.hidden.T
        dz = (z > 0) * (dp[:, None, FILTERS:] / places)
        rows, filters = np.arange(n)[:, None], np.arange(FILTERS)[None, :]
        dz[rows, best, filters] += dp[:, :FILTERS] * (np.take_along_axis(z, best[:, None], 1)[:, 0] > 0)
        dz = dz.reshape(-1, FILTERS)
        columns = np.ascontiguousarray(dz.T)
        kernel = np.zeros_like(self.kernel)
        for k in range(WIDTH):
            own = codes[:, k:k + places].ravel().astype(np.intp)
            for f in range(FILTERS):
                kernel[k, :, f] = np.bincount(own, columns[f], 256)
        return [kernel, dz.sum(0), pooled.T @ dh, dh.sum(0), h.T @ d, np.array([d.sum()])]

    def trained(self, kinds: list[np.ndarray]) -> "Network":
        """A network that went once through the codes of each kind by Adam; the shorter ones are gone
        through again until the longest is at its end."""
        net = replace(self, **{n: p.copy() for n, p in zip(_PARTS, self.parts(), strict=True)})
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parts()]
        here = [k for k, codes in enumerate(kinds) if len(codes)]
        for step in range(1, steps_of([len(codes) for codes in kinds]) + 1):
            rows = [kinds[k].take(np.arange((step - 1) * BATCH[k], step * BATCH[k]), axis=0, mode="wrap") for k in here]
            y = np.repeat([float(k == FINDING) for k in here], [len(r) for r in rows])
            weights = np.repeat([LOSS[k] / BATCH[k] for k in here], [len(r) for r in rows])
            for p, g, (m, v) in zip(net.parts(), net.gradients(np.concatenate(rows), y, weights / weights.sum()),
                                    moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= 0.01 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
        return net


_PARTS = ("kernel", "bias", "hidden", "hidden_bias", "out", "out_bias")


def steps_of(counts: list[int]) -> int:
    """Batches until every piece of each kind has been in one."""
    return max(-(-n // b) for n, b in zip(counts, BATCH, strict=True))


#: Alphabets that a finding is rewritten in: the same place, another kind of key.
_ALPHABETS = [np.frombuffer(a, np.uint8) for a in (
    b"0123456789ABCDEF", b"abcdefghijklmnopqrstuvwxyz0123456789",
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")]
_ALNUM = np.array([chr(i - 128).isalnum() if i >= 128 else False for i in range(256)])


def rewritten(codes: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Four windows of each finding: as it is, and with its characters drawn from other alphabets.

    What is drawn follows from the finding's `mark` alone.
    """
    out = np.repeat(codes[:, None], 1 + len(_ALPHABETS), axis=1)
    places = np.arange(LENGTH, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
    for i, alphabet in enumerate(_ALPHABETS, 1):
        x = (marks.view(np.uint64)[:, None] + places + np.uint64(i)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        drawn = alphabet[(x >> np.uint64(32)) % np.uint64(len(alphabet))] + np.uint8(128)
        out[:, i] = np.where(_ALNUM[codes], drawn, codes)
    return out


def set_aside(marks: np.ndarray) -> np.ndarray:
    """Which of the four windows of each finding is kept for the threshold."""
    return (marks.view(np.uint64) >> np.uint64(40)).astype(np.int64) % (1 + len(_ALPHABETS))


def examples(text: str) -> list[tuple[str, int]]:
    """(window, kind) of all of a text's pieces: findings and what is none.

    A piece that touches a base finding is a finding.  Another one is none if
    it holds a dot or five small letters in a row, which no key alphabet makes
    likely, as hosts, paths and compound words do; the rest is nobody's and
    left out.  Words of 12 letters and more are none either.
    """
    base = base_spans(text)
    out = []
    for start, end in candidates(text):
        for i, j in pieces(start, end):
            if any(s < j and i < e for _, s, e in base):
                out.append((window(text, i, j), FINDING))
            elif _OTHER.search(text, i, j):
                out.append((window(text, i, j), RUN))
    for start, end in long_words(text):
        out += [(window(text, i, j), WORD) for i, j in pieces(start, end)]
    return out


def _parts_of(parts: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The codes of each kind in each part, from rows (part, kind, mark, codes) that are sorted like that.

    A finding is three windows; the fourth is set aside.
    """
    held: list[list[np.ndarray]] = []

    def done() -> list[np.ndarray]:
        _, kind, mark, codes = (np.concatenate(c) for c in zip(*held, strict=True))
        found = rewritten(codes[kind == FINDING], mark[kind == FINDING])
        stay = np.arange(found.shape[1]) != set_aside(mark[kind == FINDING])[:, None]
        return [found[stay], codes[kind == RUN], codes[kind == WORD]]

    for batch in parts:
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)] + [codes_of(batch.column(3))]
        edges = [0, *(np.flatnonzero(np.diff(columns[0])) + 1).tolist(), batch.num_rows]
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            if i < j:
                if held and held[0][0][0] != columns[0][i]:
                    yield done()
                    held.clear()
                held.append([c[i:j] for c in columns])
    if held:
        yield done()


def codes_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, LENGTH)


def _mean(network: Network, dealt: DataFrame) -> Network:
    """The mean of the networks that start from `network` and go through one part each."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = 0, 0
        for kinds in _parts_of(parts):
            own = np.concatenate([p.ravel() for p in network.trained(kinds).parts()])
            total, n = total + np.rint(own / UNIT).astype(np.int64), n + 1
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total), pa.array(np.full(len(total), n))],
                ["place", "total", "n"])
        hand_back()

    sums = dealt.mapInArrow(run, "place int, total bigint, n bigint").groupBy("place").agg(
        F.sum("total").alias("total"), F.sum("n").alias("n")).toPandas().sort_values("place")
    flat = sums["total"].to_numpy(np.float64) / sums["n"].to_numpy() * UNIT
    cuts = np.cumsum([p.size for p in network.parts()])[:-1]
    return Network(*[own.reshape(p.shape) for own, p in zip(np.split(flat, cuts), network.parts(), strict=True)])


def _threshold(network: Network, told: DataFrame) -> float:
    """The highest threshold (in STEPS) that keeps RECALL of what is set aside, never under an even chance."""
    def work(columns: dict) -> dict:
        marks = columns["mark"].to_numpy()
        aside = rewritten(codes_of(columns["codes"]), marks)[np.arange(len(marks)), set_aside(marks)]
        return {"step": np.minimum(network.chances(aside) * STEPS, STEPS - 1).astype(np.int64)}

    steps = batches(told.where(F.col("kind") == FINDING).select(F.xxhash64("codes").alias("mark"), "codes"), work,
                    "step bigint").groupBy("step").agg(F.count(F.lit(1)).alias("n")).toPandas()
    steps = steps.sort_values("step", ascending=False)
    kept = steps["n"].cumsum() >= RECALL * steps["n"].sum()
    return max(0.5, float(steps["step"][kept].iloc[0]) / STEPS)


def learn(docs: DataFrame, text: str = "text") -> Network | None:
    """A network from all `examples` of all documents.

    Pieces are dealt into parts by the hash of what they hold, and parts are
    gone through in that order, so the network is the same however the rows are
    laid out, and copies count once.  A scarce kind goes to several parts, so
    that each of them has some.  Only a table without any finding has no
    network, or one without anything that is none.
    """
    size = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(text).cast("long")).alias("bytes")).first()
    parts = max(1, -(-size["n"] // FIT_DOCS), -(-(size["bytes"] or 0) // FIT_BYTES))

    def work(columns: dict) -> dict:
        told = [e for t in texts_of(columns[text]) for e in examples(t)]
        return {"codes": list(map(bytes, encoded([w for w, _ in told]))), "kind": [k for _, k in told]}

    told = settle(batches(docs.select(text), work, "codes binary, kind int", text=text).distinct())
    counts = {r["kind"]: r["count"] for r in told.groupBy("kind").count().collect()}
    if not counts.get(FINDING) or len(counts) == 1:
        return None
    # Parts that a piece of each kind goes to, the first of them by its hash.
    times = [min(parts, max(1, -(-parts * SCARCE // max(1, counts.get(k, 0))))) for k in (FINDING, RUN, WORD)]
    mark = F.xxhash64("codes")
    dealt = told.select("kind", mark.alias("mark"), "codes", F.explode(F.sequence(
        F.lit(0), F.element_at(F.array(*map(F.lit, times)), F.col("kind") + 1) - 1)).alias("i"))
    dealt = settle(dealt.select(
        F.pmod(F.pmod("mark", F.lit(parts)) + F.col("i"), F.lit(parts)).cast("int").alias("part"), "kind", "mark",
        "codes").repartition(parts, "part").sortWithinPartitions("part", "kind", "mark", "codes"))
    # Of a finding a part goes through three windows.
    steps = steps_of([counts.get(k, 0) * times[k] * (3 if k == FINDING else 1) // parts for k in (FINDING, RUN, WORD)])
    network = Network.start()
    for _ in range(min(MOST_ROUNDS, max(ROUNDS, -(-FIT_STEPS // max(1, steps))))):
        network = _mean(network, dealt)
    network.threshold = _threshold(network, told)
    return network


def all_spans(texts: list[str], network: Network | None) -> list[list[tuple[str, int, int]]]:
    """Base findings of each text and the candidates the network adds, by start and then kind.

    A candidate's score is that of its likeliest piece.
    """
    spans = [base_spans(t) for t in texts]
    asked, windows, firsts = [], [], []
    for row, t in enumerate(texts):
        for start, end in candidates(t) if network else ():
            if not any(s < end and start < e for _, s, e in spans[row]):
                asked.append((row, start, end))
                firsts.append(len(windows))
                windows += [window(t, i, j) for i, j in pieces(start, end)]
    best = np.maximum.reduceat(network.scores(windows), firsts) if asked else []
    for (row, start, end), score in zip(asked, best, strict=True):
        if score >= network.threshold:
            spans[row].append(("network", start, end))
    return [sorted(own, key=lambda s: (s[1], KINDS.index(s[0]))) for own in spans]


def find(docs: DataFrame, network: Network | None, doc_id: str = "doc_id", text: str = "text",
         ) -> DataFrame:
    """(doc_id, spans): kind, start and end of what is found in every whole text.

    Base findings always stay; the network adds candidates that touch none of
    them.  Null and empty texts have none.  Rows are never merged or dropped.
    """
    out_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()),
                                   ("end", pa.int64())]))

    def work(columns: dict) -> dict:
        made = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in own]
                for own in all_spans(texts_of(columns[text]), network)]
        return {"doc_id": columns[doc_id], "spans": pa.array(made, out_type)}

    return batches(docs.select(doc_id, text), work, "doc_id %s, spans array<struct<kind:string,"
                   "start:bigint,end:bigint>>" % docs.schema[doc_id].dataType.simpleString(), text=text)


def blacked_out(text: str, spans: list[tuple[str, int, int]], mark: str) -> str:
    """The text with `mark` for every span; spans that overlap are one."""
    parts, at = [], 0
    for _, start, end in spans:
        if start >= at:
            parts += [text[at:start], mark]
        at = max(at, end)
    return "".join(parts) + text[at:]


def redacted(docs: DataFrame, network: Network | None, mark: str = "[secret]") -> DataFrame:
    """`docs` with every span replaced by `mark`.

    All documents stay, a null text stays null, and `n_chars`, where there is
    one, is counted anew for changed texts.
    """
    others = [c for c in docs.columns if c != "text"]
    ddl = ", ".join("`%s` %s" % (c.replace("`", "``"), docs.schema[c].dataType.simpleString())
                    for c in others)

    def work(columns: dict) -> dict:
        texts = columns["text"].to_pylist()
        spans = all_spans([t or "" for t in texts], network)
        return {**{c: columns[c] for c in others},
                "text": [blacked_out(t, s, mark) if s else t for t, s in zip(texts, spans, strict=True)],
                "changed": [bool(s) for s in spans]}

    made = batches(docs.select(*others, "text"), work,
                   ddl + (", " if ddl else "") + "text string, _changed boolean", text="text")
    if "n_chars" in others:
        made = made.withColumn("n_chars", F.when(
            F.col("_changed"), F.char_length("text").cast(docs.schema["n_chars"].dataType)
        ).otherwise(F.col("n_chars")))
    return made.select(*docs.columns)


def op6_secrets(spark, sf_dir: str) -> DataFrame:
    """Findings of every document, counted by kind and listed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find(docs, learn(docs))
    base = F.filter("spans", lambda s: s["kind"] != "network")
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(k).alias("n_" + k) for k in KINDS[:3]],
                        F.sha2(listed(base), 256).alias("base_sha256"),
                        listed(F.col("spans")).alias("spans"))
