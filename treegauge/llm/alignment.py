"""Cross-tokenizer alignment by lockstep vectorised merging.

Two tokenizers cut the same bytes differently.  A pointer into the tokens of
either moves over each text; where both tokens end at the same byte is a cut,
and what lies between two cuts is a group, all of whose tokens are linked.  The
pointers of all texts of a batch are one NumPy state vector: each step moves
all of them, marks the cuts it meets, and texts that are done leave the vector.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import batches, bytes_of, folder_for, hand_back, settle, slices, table
from .pieces import PieceTokens

#: Pieces of a text that one place of the state vector merges.
SECTION = 192
#: Links that are written out at a time; groups with more are taken by distinct tokens.
LINKS = 1 << 20
#: Pairs of ids that a task adds up before it passes them on, that a bucket of the counted
#: pairs holds, and that the documents of one part bring to be looked up.
ADDED, BUCKET, PART = 4_000_000, 1_000_000, 16_000_000

#: A piece begins at a space or line feed after a visible character.  No token of either
#: kind of vocabulary reaches over that place: a byte-level pattern takes white space only in
#: front of visible characters, and no piece of the other has a space behind a character.
_EDGE = re.compile(r"(?<=\S)(?=[ \n])")
_RUN = re.compile(r"\s[ \n]")
#: What a piece vocabulary writes for a space; in a text of its own it is ambiguous.
SPACE = "▁"


def pieces_of(text: str) -> list[str]:
    """The text behind one space, in pieces; joined they give it back."""
    if "\0" in text or _RUN.search(text) or text[:1].isspace():
        return _EDGE.split(" " + text)
    marked = text.replace(" ", "\0 ").replace("\n", "\0\n")
    return ("\0 " + marked).split("\0")[1:]


class BytePieces(PieceTokens):
    """Tokens of a byte-level vocabulary; its special strings in a text are plain text."""

    def __init__(self, path: str):
        super().__init__(path, True)
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(path)
        self.plain.no_truncation()
        self.plain.no_padding()
        self.plain.encode_special_tokens = True
        self.size = self.plain.get_vocab_size()
        # Each character of a token stands for one byte.
        self.n_bytes = np.array([len(self.plain.id_to_token(i) or "") for i in range(self.size)], np.int64)

    def _learn(self, pieces: list[str]) -> None:
        odd = [p for p in pieces if any(s in p for s in self.specials)]
        for piece in odd:
            ids = np.array(self.plain.encode(piece, add_special_tokens=False).ids, np.uint32)
            self._store([piece], ids, np.array([len(ids)]))
        super()._learn([p for p in pieces if p not in set(odd)] if odd else pieces)


class SentencePieces(PieceTokens):
    """Tokens of a piece vocabulary that puts a space before every text."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.processor = SentencePieceProcessor(model_file=path)
        self.size = self.processor.get_piece_size()
        names = [self.processor.id_to_piece(i) for i in range(self.size)]
        self.n_bytes = np.array([1 if self.processor.is_byte(i) else len(n.replace(SPACE, " ").encode())
                                 for i, n in enumerate(names)], np.int64)
        if any(SPACE in n.lstrip(SPACE) or "\n" in n for n in names):
            raise ValueError("texts of this vocabulary cannot be cut at spaces and line feeds")
        self.space = self.processor.piece_to_id(SPACE)
        self.keep_ids = True
        self._empty()

    def _learn(self, pieces: list[str]) -> None:
        # The vocabulary's own space stands for the first one of a piece.
        made = self.processor.encode([p[1:] if p[:1] == " " else p for p in pieces], num_threads=1)
        for k, piece in enumerate(pieces):
            if piece[:1] == " ":
                # Nothing but a space: an empty text has no tokens.
                made[k] = made[k] or ([self.space] if len(piece) == 1 else [])
            elif made[k][:1] == [self.space]:
                made[k] = made[k][1:]
            else:
                raise ValueError("a line feed must not merge with what stands before it")
        lengths = np.array([len(m) for m in made], np.int64)
        self._store(pieces, np.array([i for m in made for i in m], np.uint32), lengths)


_LOADED: dict[str, PieceTokens] = {}


def loaded(path: str) -> PieceTokens:
    """The worker's own, kept from task to task: by the library that reads the file."""
    if path not in _LOADED:
        _LOADED[path] = (BytePieces if path.endswith(".json") else SentencePieces)(path)
    return _LOADED[path]


def merged(ends_a: np.ndarray, ends_b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray,
           last_a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last tokens of all groups on both sides, in order.

    `ends_*` are the byte ends of all tokens; text k has the A tokens from
    `first_a[k]` up to `last_a[k]`, and its B tokens begin at `first_b[k]`.
    One step moves the pointer whose token ends first in every text, and both
    where the ends agree: there the group is cut.
    """
    cut_a, cut_b = np.zeros(len(ends_a), bool), np.zeros(len(ends_b), bool)
    own = first_a < last_a
    a, b, last = first_a[own], first_b[own], last_a[own]
    while len(a):
        x, y = ends_a[a], ends_b[b]
        met = x == y
        cut_a[a[met]] = True
        cut_b[b[met]] = True
        a = a + (x <= y)
        b = b + (y <= x)
        going = a < last
        if not going.all():
            a, b, last = a[going], b[going], last[going]
    return np.flatnonzero(cut_a), np.flatnonzero(cut_b)


class Aligned:
    """Tokens of both sides of some texts, their groups, and their links."""

    def __init__(self, texts: list[str], a: PieceTokens, b: PieceTokens):
        split: list[list[str]] = []
        for t in texts:
            # The space mark would come back as a space: the bytes differ, so there are no tokens.
            split.append(pieces_of(t) if t and SPACE not in t else [])
        flat = [p for s in split for p in s]
        sizes = np.array([len(s) for s in split], np.int64)
        edges = np.concatenate([[0], np.cumsum(sizes)])
        n = a.numbers(flat)
        self.a, count_a = a.flat(n).astype(np.int64), a.lengths[n]
        n = b.numbers(flat)
        self.b, count_b = b.flat(n).astype(np.int64), b.lengths[n]
        ends_a, ends_b = np.cumsum(a.n_bytes[self.a]), np.cumsum(b.n_bytes[self.b])
        at_a = np.concatenate([[0], np.cumsum(count_a)])
        at_b = np.concatenate([[0], np.cumsum(count_b)])
        if flat:
            # Both sides must give back every piece, byte for byte in number and place.
            own = np.cumsum([len(p.encode()) for p in flat])
            if not (np.array_equal(ends_a[at_a[1:] - 1], own) and np.array_equal(ends_b[at_b[1:] - 1], own)):
                raise ValueError("tokens do not give back the bytes of their texts")
        # Sections of a text begin where a piece does, which is a cut on both sides.
        begin = [np.arange(edges[k], edges[k + 1], SECTION) for k in range(len(texts))]
        sections = np.concatenate([np.zeros(0, np.int64), *begin])
        stop = np.minimum(sections + SECTION, np.repeat(edges[1:], [len(s) for s in begin]))
        self.end_a, self.end_b = merged(ends_a, ends_b, at_a[sections], at_b[sections], at_a[stop])
        self.first_a = np.concatenate([[0], self.end_a[:-1] + 1]) if len(self.end_a) else self.end_a
        self.first_b = np.concatenate([[0], self.end_b[:-1] + 1]) if len(self.end_b) else self.end_b
        self.n_a, self.n_b = self.end_a - self.first_a + 1, self.end_b - self.first_b + 1
        #: Where each text's tokens and groups begin.
        self.text_a, self.text_b = at_a[edges], at_b[edges]
        self.text_group = np.searchsorted(self.end_a, self.text_a)

    def per_text(self, of_groups: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(of_groups)])
        return sums[self.text_group[1:]] - sums[self.text_group[:-1]]

    def links(self, n_b: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(text, pair, times) of every link; a pair is its A id times `n_b` plus its B id.

        Groups of many tokens give each pair once, with its number.
        """
        text = np.repeat(np.arange(len(self.text_group) - 1), np.diff(self.text_group))
        counts = self.n_a * self.n_b
        for g in np.flatnonzero(counts > LINKS).tolist():
            ids_a, times_a = np.unique(self.a[self.first_a[g]:self.end_a[g] + 1], return_counts=True)
            ids_b, times_b = np.unique(self.b[self.first_b[g]:self.end_b[g] + 1], return_counts=True)
            step = max(1, LINKS // len(ids_b))
            for i in range(0, len(ids_a), step):
                pair = (ids_a[i:i + step, None] * n_b + ids_b).ravel()
                yield np.full(len(pair), text[g]), pair, (times_a[i:i + step, None] * times_b).ravel()
        small = np.flatnonzero(counts <= LINKS)
        sums = np.cumsum(counts[small])
        begin = 0
        while begin < len(small):
            stop = max(begin + 1, int(np.searchsorted(sums, (sums[begin - 1] if begin else 0) + LINKS, "right")))
            g = small[begin:stop]
            begin = stop
            n = counts[g]
            own = np.repeat(g, n)
            k = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
            i = k // self.n_b[own]
            yield (text[own], self.a[self.first_a[own] + i] * n_b
                   + self.b[self.first_b[own] + k - i * self.n_b[own]], np.ones(len(own), np.int64))

    def written(self, names_a: np.ndarray, names_b: np.ndarray) -> list[bytes]:
        """The groups of each text as `a1,a2|b1;a3|b2,b3`."""
        n, m = len(self.a), len(self.b)
        if not n:
            return [b""] * (len(self.text_a) - 1)
        # All tokens of both sides in the order they are written: a group's A, then its B.
        place_a = np.arange(n) + np.repeat(self.first_b, self.n_a)
        place_b = np.arange(m) + np.repeat(self.end_a + 1, self.n_b)
        row = np.zeros(n, np.int64)
        row[self.end_a] = 1
        items = np.empty(n + m, object)
        items[place_a] = names_a[row, self.a]
        row = np.zeros(m, np.int64)
        row[self.end_b] = 1
        items[place_b] = names_b[row, self.b]
        edges = (self.text_a + self.text_b).tolist()
        flat = items.tolist()
        return [b"".join(flat[i:j])[:-1] for i, j in zip(edges[:-1], edges[1:], strict=True)]


def names(size: int, ends: tuple[bytes, bytes]) -> np.ndarray:
    """Every id in decimals, with what follows it inside a group and at its end."""
    out = np.empty((2, size), object)
    for r, end in enumerate(ends):
        out[r] = [b"%d%s" % (i, end) for i in range(size)]
    return out


def packed(values: np.ndarray) -> bytes:
    """Numbers as compressed bytes, their like bytes together."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<i8").ravel()


def pairs_by_text(links: Iterator, n_texts: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each text's distinct pairs in order, and how many links each has."""
    texts, pairs, times = [], [], []
    for t, p, n in links:
        t, p, n = summed(t, p, n)
        texts.append(t)
        pairs.append(p)
        times.append(n)
    if len(texts) != 1:
        none = [np.zeros(0, np.int64)]
        t, p, n = summed(*(np.concatenate(none + c) for c in (texts, pairs, times)))
    edges = np.searchsorted(t, np.arange(n_texts + 1))
    return [(p[i:j], n[i:j]) for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


def summed(text: np.ndarray, pair: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows with one text and pair added up, in order."""
    width = int(pair.max(initial=0)) + 1
    key = text * width + pair
    if times.max(initial=0) <= 1:
        key = np.sort(key)
        first = np.flatnonzero(np.diff(key, prepend=-1))
        n = np.diff(first, append=len(key))
    else:
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        n = np.add.reduceat(times[order], first) if len(first) else times[:0]
    return key[first] // width, key[first] % width, n


_ALIGNED = ("n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
            "n_pairs bigint, pairs binary, times binary")


def aligned(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id",
            text: str = "text") -> DataFrame:
    """Per text: tokens, groups and links of both sides, a digest of the groups, its pairs.

    `pairs` are the distinct linked ids in order (A id times the size of the B
    vocabulary plus B id) and `times` their links, both `packed`, the pairs as
    differences.  Null and empty texts, and texts with the character that
    stands for a space, have no tokens: zeros, and the digest ''.  Repeated
    rows repeat; other columns are left out.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def work(columns: dict, known: tuple) -> dict:
        a, b, names_a, names_b = known.own
        texts = [t.decode() for t in bytes_of(columns[text])]
        made = Aligned(texts, a, b)
        of_text = pairs_by_text(made.links(b.size), len(texts))
        n_a = np.diff(made.text_a)
        return {"doc_id": columns[doc_id], "n_a": n_a, "n_b": np.diff(made.text_b),
                "n_groups": np.diff(made.text_group), "n_links": made.per_text(made.n_a * made.n_b),
                "sha": [hashlib.sha256(w).hexdigest() if n else "" for w, n in
                        zip(made.written(names_a, names_b), n_a.tolist(), strict=True)],
                "n_pairs": [len(p) for p, _ in of_text],
                "pairs": [packed(np.diff(p, prepend=0)) for p, _ in of_text],
                "times": [packed(n) for _, n in of_text]}

    return batches(docs.select(doc_id, text), work, "doc_id %s, %s" % (kind, _ALIGNED),
                   lambda: Sides(path_a, path_b), text)


class Sides:
    """Both tokenizers of a worker, with the names of their ids."""

    _NAMES: dict[tuple[int, bytes], np.ndarray] = {}

    def __init__(self, path_a: str, path_b: str):
        a, b = loaded(path_a), loaded(path_b)
        self.own = (a, b, self._named(a.size, (b",", b"|")), self._named(b.size, (b",", b";")))

    def _named(self, size: int, ends: tuple[bytes, bytes]) -> np.ndarray:
        if (size, ends[1]) not in self._NAMES:
            self._NAMES[size, ends[1]] = names(size, ends)
        return self._NAMES[size, ends[1]]

    def rest(self) -> None:
        for side in self.own[:2]:
            side.rest()


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n): how many rows hold each pair; tasks add up before the shuffle."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        new: list[np.ndarray] = []
        held = 0

        def added() -> tuple[np.ndarray, np.ndarray]:
            own, n = np.unique(np.concatenate([np.zeros(0, np.int64), *new]), return_counts=True)
            key = np.concatenate([pairs, own])
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.diff(key, prepend=-1))
            if not len(first):
                return pairs, counts
            return key[first], np.add.reduceat(np.concatenate([counts, n])[order], first)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], ["pair", "n"])

        for part in parts:
            for data in part.column(0).to_pylist():
                own = np.cumsum(unpacked(data))
                new.append(own)
                held += len(own)
                if held > ADDED:
                    pairs, counts = added()
                    new, held = [], 0
                    if len(pairs) > ADDED:
                        yield out()
                        pairs, counts = pairs[:0], counts[:0]
        pairs, counts = added()
        yield out()
        hand_back()

    return rows.select("pairs").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(
        F.sum("n").alias("n"))


def scored(rows: DataFrame, key: str, n_b: int) -> DataFrame:
    """(key, n_best, count_sum) of rows (key, pairs, times): their links against all rows' counts.

    Counted pairs are dealt into buckets by A id, which hold BUCKET of them
    on average, and rows into as many shares as PART asks for.  A part is one bucket and
    one share: a task reads the part's counted pairs, then streams its rows.
    """
    counts = settle(pair_counts(rows))
    of_a = F.expr("pair div %d" % n_b)
    best = counts.groupBy(of_a.alias("a")).agg(F.max("n").alias("most"))
    told = counts.withColumn("a", of_a).join(best, "a").select(
        "pair", "n", (F.col("n") == F.col("most")).alias("best"))
    size = counts.count()
    buckets = max(1, -(-size // BUCKET))
    total = rows.agg(F.sum("n_pairs")).first()[0] or 0
    shares = max(1, -(-total // (buckets * PART)))

    def dealt(pair: np.ndarray) -> np.ndarray:
        return (pair // n_b * 0x9E3779B1 >> 8) % buckets

    def table_rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            pair, n, top = (part.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            order = np.lexsort((pair, dealt(pair)))
            pair, value = pair[order], (n * 2 + top)[order]
            edges = np.searchsorted(dealt(pair), np.arange(buckets + 1))
            own = np.flatnonzero(np.diff(edges))
            yield pa.RecordBatch.from_arrays(
                [pa.array(own.astype(np.int64)),
                 pa.array([packed(np.diff(pair[edges[k]:edges[k + 1]], prepend=0)) for k in own], pa.binary()),
                 pa.array([packed(value[edges[k]:edges[k + 1]]) for k in own], pa.binary())],
                ["bucket", "pairs", "values"])

    def row_parts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for piece in slices(part, "pairs"):
                where, who, pairs, times = [], [], [], []
                for k, (data, numbers) in enumerate(zip(piece.column(1).to_pylist(),
                                                        piece.column(2).to_pylist(), strict=True)):
                    if buckets == 1:
                        own = [(0, data, numbers)]
                    else:
                        pair, n = np.cumsum(unpacked(data)), unpacked(numbers)
                        order = np.argsort(dealt(pair), kind="stable")
                        edges = np.searchsorted(dealt(pair)[order], np.arange(buckets + 1))
                        own = [(int(i), packed(np.diff(pair[order[edges[i]:edges[i + 1]]], prepend=0)),
                                packed(n[order[edges[i]:edges[i + 1]]]))
                               for i in np.flatnonzero(np.diff(edges))]
                    for bucket, d, m in own:
                        where.append(bucket)
                        who.append(k)
                        pairs.append(d)
                        times.append(m)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(where, pa.int64()), piece.column(0).take(pa.array(who, pa.int64())),
                     pa.array(pairs, pa.binary()), pa.array(times, pa.binary())],
                    ["bucket", "key", "pairs", "values"])

    blobs = told.mapInArrow(table_rows, "bucket bigint, pairs binary, values binary")
    blobs = blobs.select("bucket", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shares - 1).cast("bigint"))).alias("share"),
                         F.lit(None).cast("bigint").alias("key"), "pairs", "values")
    asked = rows.where("n_pairs > 0").select(key, "pairs", "times").mapInArrow(
        row_parts, "bucket bigint, key bigint, pairs binary, values binary")
    asked = asked.select("bucket", F.pmod(F.xxhash64("key"), F.lit(shares)).alias("share"), "key", "pairs", "values")
    parts = blobs.unionByName(asked).withColumn("part", F.col("bucket") * shares + F.col("share"))
    # The counted pairs of a part have no key and stand first.
    told_rows = parts.repartition(buckets * shares, "part").sortWithinPartitions(
        "part", F.asc_nulls_first("key")).select("part", "key", "pairs", "values")

    def look_up(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, building, known, value = None, [], None, None
        for batch in batches_:
            which, who = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            data, numbers = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            out = []
            for w, k, d, n in zip(which, who, data, numbers, strict=True):
                if w != now:
                    now, building, known = w, [], None
                if k is None:
                    building.append((np.cumsum(unpacked(d)), unpacked(n)))
                    continue
                if known is None:
                    known = np.concatenate([p for p, _ in building])
                    order = np.argsort(known)
                    known, value = known[order], np.concatenate([v for _, v in building])[order]
                    building = []
                found = value[np.searchsorted(known, np.cumsum(unpacked(d)))]
                times = unpacked(n)
                out.append((k, int(times[found & 1 == 1].sum()), int((times * (found >> 1)).sum())))
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols],
                                             ["key", "n_best", "count_sum"])
        hand_back()

    met = told_rows.mapInArrow(look_up, "key bigint, n_best bigint, count_sum bigint")
    return met.groupBy("key").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def alignment(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id",
              text: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row.

    The count of a pair of ids is the number of rows that hold it linked;
    `n_best` counts links whose count is the highest of their A id, ties
    included, and `count_sum` adds the counts of all links.  Rows are told
    apart by a number of their own, so null and repeated ids do no harm.
    What the tokenizers gave is written to the shared folder once and read by
    both the counting and the look-up.  No rows give no rows.
    """
    spark = docs.sparkSession
    folder = folder_for(spark, "alignment")
    aligned(docs, path_a, path_b, doc_id, text).withColumn(
        "row", F.monotonically_increasing_id()).write.parquet(folder)
    rows = spark.read.parquet(folder)
    sums = scored(rows, "row", loaded(path_b).size).withColumnRenamed("key", "row")
    return rows.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(
        sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256")


def op12_alignment(spark, sf_dir: str) -> DataFrame:
    """Tokens, groups and links of every document under the two vocabularies."""
    import public_tokenizers

    return alignment(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                     public_tokenizers.path("piece_bpe_32k.model"))
