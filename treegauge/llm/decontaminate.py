"""Benchmark decontamination by latent semantic retrieval.

Passages of all documents are TF-IDF vectors over hashed words, with document
frequencies of the whole corpus.  A randomised singular value decomposition,
run over all of them, gives a latent space.  Every window of every
document is compared with the benchmark items there; near ones are candidates,
and a candidate counts if the longest common subsequence of words holds the
item, or half of its words and of their weight and the item's answer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from treegauge.session import for_one_action

from .common import batches, bytes_of, hand_back, settle, slices, table

#: Hashed vocabulary, words of a passage, latent dimensions and what the sketch has beyond.
BITS = 16
BUCKETS = 1 << BITS
PASSAGE = 32
LATENT, EXTRA, POWER = 64, 16, 2
#: A word in more than one of so many passages is common.
COMMON = 50
#: Passages that are written as one row, and that a task of the fit has where all cores have one.
STORED, FIT_PASSAGES = 1 << 14, 1 << 20
#: Rows of the block that are gathered at once in the fit.
GATHERED = 1 << 11
#: Lengths that a bucket's list of passages is filled up to; longer lists are added up one by one.
LENGTHS = np.unique([[1 << k, 3 << k >> 1] for k in range(10)])
#: Window lengths in words; an item is looked for in the least that holds it, else the longest.
SCALES = (16, 24, 32, 48, 64)
#: A word in fewer than one of so many passages weighs no more in the search.
RARE = 370
#: Cosine in the latent space from which a window is a candidate.
NEAR = 0.42
#: The same for an item that fills less than half of its window.
NEAR_SHORT = 0.36
#: Share of an item, in words and in weight, that counts alone, and that counts with its answer.
WHOLE, HALF, ANSWER = 0.65, 0.5, 0.8
#: An item under so many words counts whole only: half of it is too likely by chance.
PARAPHRASE = 16
#: An item under so many words is too short to be told from chance.
SHORTEST = 5
#: Words that are added up first, and the blocks of them that are compared at once.
BLOCK, STRETCH = 8, 2048
#: Items that one pass over the documents looks for.
ITEM_BLOCK = 4000
#: Bytes that are hashed at once, and letters of a word that are added up place by place.
CHUNK, LETTERS = 1 << 18, 32

#: Letters and digits in lower case; 0 ends a word.
_FOLD = np.array([i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128
                  else 0 for i in range(256)], np.uint8)
_POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))
#: Sums of the first powers.
_UPTO = np.append(np.uint64(0), np.cumsum(_POWERS[:LETTERS]))


def hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts, and where each text's words begin (and end).

    Words are runs of ASCII letters and digits and of all other characters
    beyond ASCII; A-Z are folded.
    """
    hashes, counts = [], []
    group: list[bytes] = []
    size = 0
    for t in texts:
        if group and size + len(t) > CHUNK:
            h, c = _hash_group(group)
            hashes.append(h)
            counts.append(c)
            group, size = [], 0
        group.append(t)
        size += len(t) + 1
    if group:
        h, c = _hash_group(group)
        hashes.append(h)
        counts.append(c)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    return np.concatenate(hashes), np.concatenate([[0], np.cumsum(np.concatenate(counts))])


def _hash_group(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    folded = _FOLD[np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)]
    inside = folded != 0
    edge = np.flatnonzero(np.diff(inside, prepend=False))
    starts, ends = edge[::2], edge[1::2]
    lengths = ends - starts
    # The k-th letters of all words that have one, the longest words first.
    order = np.argsort(-np.minimum(lengths, LETTERS + 1).astype(np.int8), kind="stable")
    at, size = starts[order], lengths[order]
    having = np.searchsorted(-size, -np.arange(LETTERS + 1))
    sums = _UPTO[np.minimum(size, LETTERS)]
    for k in range(LETTERS):
        letters = folded[at[:having[k]] + k].astype(np.uint64)
        letters *= _POWERS[k]
        sums[:having[k]] += letters
    long = having[LETTERS]
    if long:
        first = np.cumsum(size[:long]) - size[:long]
        place = np.arange(size[:long].sum()) - np.repeat(first, size[:long])
        letters = folded[np.repeat(at[:long], size[:long]) + place].astype(np.uint64)
        sums[:long] = np.add.reduceat((letters + np.uint64(1)) * _POWERS[place & 63], first)
    words = np.empty(len(sums), np.uint64)
    words[order] = sums
    words ^= words >> np.uint64(29)
    bounds = np.cumsum([len(t) + 1 for t in texts])
    upto = np.searchsorted(starts, bounds)
    return words * np.uint64(0xBF58476D1CE4E5B9), np.diff(upto, prepend=0)


def buckets_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64)


def passages(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Rows of PASSAGE buckets, sorted, BUCKETS where a document's last passage ends early."""
    sizes = np.diff(bounds)
    rows = -(-sizes // PASSAGE)
    out = np.full((int(rows.sum()), PASSAGE), BUCKETS, np.int32)
    shift = (np.cumsum(rows) - rows) * PASSAGE - bounds[:-1]
    out.ravel()[np.arange(len(hashes)) + np.repeat(shift, sizes)] = buckets_of(hashes)
    out.sort(axis=1)
    return out


def kept_passages(docs: DataFrame, text: str = "text") -> DataFrame:
    """(buckets, sizes): the passages of all documents, written once.

    A row has up to STORED of them: two bytes for each word, passage after
    passage, and a byte with the words of each.
    """
    def cut(columns: dict) -> dict:
        rows = passages(*hashed(bytes_of(columns[text])))
        some = [rows[i:i + STORED] for i in range(0, len(rows), STORED)]
        return {"buckets": [r[r < BUCKETS].astype(np.uint16).tobytes() for r in some],
                "sizes": [(r < BUCKETS).sum(1).astype(np.uint8).tobytes() for r in some]}

    return settle(batches(docs.select(text), cut, "buckets binary, sizes binary", text=text))


def _read(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets and sizes of at least STORED passages together, but for the last."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for part in parts:
        for buckets, sizes in zip(part.column(0), part.column(1), strict=True):
            # Copies: the batch goes before its passages are gone through.
            held.append((np.frombuffer(buckets.as_py(), np.uint16), np.frombuffer(sizes.as_py(), np.uint8)))
            if sum(len(n) for _, n in held) >= STORED:
                yield tuple(map(np.concatenate, zip(*held, strict=True)))
                held = []
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def frequencies(kept: DataFrame) -> np.ndarray:
    """In how many passages of all documents each bucket is; last, the passages.

    A task adds up its own passages and sends one row for each bucket it met.
    """
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS + 1, np.int64)
        for buckets, sizes in _read(parts):
            new = np.ones(len(buckets), bool)
            new[1:] = buckets[1:] != buckets[:-1]
            new[np.cumsum(sizes, dtype=np.int64) - sizes] = True
            counts[:BUCKETS] += np.bincount(buckets[new], minlength=BUCKETS)
            counts[BUCKETS] += len(sizes)
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(counts[met])], ["bucket", "n"])
        hand_back()

    sums = for_one_action(kept.mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(
        F.sum("n").alias("n"))).toPandas()
    out = np.zeros(BUCKETS + 1, np.int64)
    out[sums["bucket"]] = sums["n"]
    return out


def weights_of(counts: np.ndarray) -> np.ndarray:
    """Squared inverse passage frequency above that of common words, which weigh next to nothing.

    With plain frequencies the leading directions are the languages of the
    corpus, and all passages of a language are near each other.
    """
    idf = np.log((1 + counts[BUCKETS]) / (1 + counts[:BUCKETS]))
    return np.maximum(idf - np.log(COMMON), 0.0) ** 2 + 0.01


def search_weights_of(counts: np.ndarray) -> np.ndarray:
    """Inverse passage frequency between COMMON and RARE, for the search.

    One foreign word, however rare, then counts no more than one of the item,
    and a word's weight does not grow with the corpus.
    """
    idf = np.log((1 + counts[BUCKETS]) / (1 + counts[:BUCKETS]))
    return np.clip(idf - np.log(COMMON), 0.02, np.log(RARE / COMMON))


def _lists(rows: np.ndarray) -> pa.Array:
    """A matrix as an Arrow column of lists."""
    edges = np.arange(0, rows.size + 1, rows.shape[1] if rows.size else 1, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(rows.ravel()))


def add_products(total: np.ndarray, buckets: np.ndarray, sizes: np.ndarray,
                 weight: np.ndarray, block: np.ndarray) -> None:
    """Adds A'A block to `total`, a row for each bucket, A being the passages as weighted rows of length 1.

    A block is gathered for the words of some passages, and what these see of
    it for the passages of some buckets: lists of passages are filled up to one
    of LENGTHS, and all of a length are added up at once.
    """
    inside = np.arange(PASSAGE) < sizes[:, None]
    rows = np.zeros(inside.shape, np.uint16)
    rows[inside] = buckets
    share = np.where(inside, weight[rows], np.float32(0))
    share /= np.maximum(1e-6, np.sqrt(np.einsum("ij,ij->i", share, share)))[:, None]
    width = block.shape[1]
    room = np.empty((GATHERED, width), np.float32)

    def gathered(source: np.ndarray, places: np.ndarray) -> np.ndarray:
        return np.take(source, places, axis=0, out=room[:len(places)], mode="clip")

    seen = np.empty((len(rows), width), np.float32)
    step = GATHERED // PASSAGE
    for i in range(0, len(rows), step):
        own = gathered(block, rows[i:i + step].ravel()).reshape(-1, PASSAGE, width)
        np.matmul(share[i:i + step, None], own, out=seen[i:i + step, None])

    order = np.argsort(buckets, kind="stable")
    passage = np.repeat(np.arange(len(sizes)), sizes)[order]
    share = share[inside][order]
    size = np.bincount(buckets, minlength=BUCKETS)
    met = np.flatnonzero(size)
    size = size[met]
    first = np.cumsum(size) - size
    long = size > LENGTHS[-1]
    for k in np.flatnonzero(long):
        end = first[k] + size[k]
        for i in range(first[k], end, GATHERED):
            upto = min(end, i + GATHERED)
            total[met[k]] += share[i:upto] @ gathered(seen, passage[i:upto])

    # The lists of a length lie one after the other, passage 0 with no share where they are filled up.
    length = LENGTHS[np.searchsorted(LENGTHS, np.where(long, 1, size))] * ~long
    by = np.argsort(length, kind="stable")
    start = np.empty(len(by), np.int64)
    start[by] = np.cumsum(length[by]) - length[by]
    short = np.repeat(~long, size)
    to = (np.repeat(start - first, size) + np.arange(len(order)))[short]
    passages_at = np.zeros(int(length.sum()), np.int64)
    passages_at[to] = passage[short]
    shares_at = np.zeros(len(passages_at), np.float32)
    shares_at[to] = share[short]
    edges = np.append(np.searchsorted(length[by], LENGTHS), len(by))
    for n, low, high in zip(LENGTHS.tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        step = max(1, GATHERED // n)
        for i in range(low, high, step):
            own = by[i:min(high, i + step)]
            at = slice(start[own[0]], start[own[0]] + n * len(own))
            lists = gathered(seen, passages_at[at]).reshape(-1, n, width)
            shares = shares_at[at].reshape(-1, 1, n)
            # So short, they are added up faster than they are called for one by one.
            total[met[own]] += (sum(shares[:, :, k] * lists[:, k] for k in range(n)) if n <= 4
                                else np.matmul(shares, lists)[:, 0])


def latent_space(kept: DataFrame, counts: np.ndarray) -> np.ndarray:
    """A matrix from buckets to LATENT dimensions, weights included.

    Randomised SVD over all passages A: each round multiplies A'A with a block
    of LATENT + EXTRA vectors, tasks adding up their passages, and makes the
    block orthogonal again.  The first direction, common to all passages, is
    left out.  A few directions hold little of a rare word; the remainder of
    each word is sketched in the same dimensions by a random direction, so that
    the cosine of two windows is that of their TF-IDF vectors, bent towards
    words used alike.
    """
    width = LATENT + EXTRA
    idf = search_weights_of(counts)
    weight = idf.astype(np.float32)
    # A task sends as much as the block has, so there are no more than cores unless it has much to add up.
    cores = kept.sparkSession.sparkContext.defaultParallelism
    dealt = kept.coalesce(max(cores, -(-int(counts[BUCKETS]) // FIT_PASSAGES)))

    def times(block: np.ndarray) -> np.ndarray:
        """A'A block, the rows of each bucket added up in the shuffle.

        The block is as large as the partial sums; each round's copies on the
        disks of driver and executors go before the next.
        """
        shared = kept.sparkSession.sparkContext.broadcast(block)

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((BUCKETS, width), np.float32)
            for buckets, sizes in _read(parts):
                add_products(total, buckets, sizes, weight, shared.value)
            met = np.flatnonzero(np.abs(total).sum(1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(met), _lists(total[met])], ["bucket", "v"])
            del total
            hand_back()

        def added(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for part in parts:
                block = part.column(1).flatten().to_numpy().reshape(-1, width)
                for b, v in zip(part.column(0).to_pylist(), block, strict=True):
                    total[b] = total[b] + v if b in total else v.astype(np.float64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.int64()),
                 _lists(np.array(list(total.values()), np.float32).reshape(-1, width))],
                ["bucket", "v"])

        schema = "bucket bigint, v array<float>"
        told = for_one_action(
            dealt.mapInArrow(run, schema).repartition("bucket").mapInArrow(added, schema)).toArrow()
        shared.destroy()
        out = np.zeros((BUCKETS, width), np.float32)
        for part in told.to_batches():
            out[part.column(0).to_numpy()] = part.column(1).flatten().to_numpy().reshape(-1, width)
        return out

    basis = np.random.default_rng(42).standard_normal((BUCKETS, width), np.float32)
    basis = _orthogonal(basis)
    for _ in range(POWER):
        basis = _orthogonal(times(basis))
    squares, turn = np.linalg.eigh(_product(basis, times(basis)))
    words = basis @ turn[:, np.argsort(-squares)[1:LATENT + 1]].astype(np.float32)
    del basis
    # Directions have no sign of their own: it followed rounding, and so the layout of the rows.
    words *= np.copysign(np.float32(1), words[np.abs(words).argmax(0), np.arange(LATENT)])
    # What of a word lies outside the latent directions is sketched by a direction of its own.
    rest = np.random.default_rng(43).standard_normal(words.shape, np.float32)
    rest *= np.sqrt(np.maximum(0.0, 1.0 - np.einsum("ij,ij->i", words, words))
                    / np.einsum("ij,ij->i", rest, rest))[:, None]
    words += rest
    words *= idf[:, None].astype(np.float32)
    return words


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a'b in double precision, a few rows at a time."""
    step = 4096
    return sum(a[i:i + step].T.astype(np.float64) @ b[i:i + step].astype(np.float64)
               for i in range(0, len(a), step))


def _orthogonal(block: np.ndarray) -> np.ndarray:
    """The block's columns made orthogonal by their own products; those without length are zero.

    Done twice, for once leaves what rounding left in the products.
    """
    for _ in range(2):
        size, turn = np.linalg.eigh(_product(block, block))
        scale = np.where(size > size[-1] * 1e-13, 1 / np.sqrt(np.maximum(size, 1e-300)), 0.0)
        block = block @ (turn * scale).astype(np.float32)
    return block


@dataclass
class Item:
    """A benchmark item as its words' hashes, with masks for the common subsequence."""

    item_id: object
    words: np.ndarray
    answer_from: int
    weights: np.ndarray
    masks: dict[int, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.distinct = np.unique(self.words)
        for i, w in enumerate(self.words.tolist()):
            self.masks[w] = self.masks.get(w, 0) | 1 << i

    def own(self, region: np.ndarray) -> np.ndarray:
        """The words of `region` that the item has; the others are in no common subsequence."""
        at = np.searchsorted(self.distinct, region)
        return region[self.distinct[np.minimum(at, len(self.distinct) - 1)] == region]

    def shares(self, region: list[int]) -> tuple[float, float, float]:
        """Shares of the item's words, of their weight and of its answer that `region` has in order.

        Bit-parallel longest common subsequence: a zero bit is a matched place.
        """
        n = len(self.words)
        full = (1 << n) - 1
        row = full
        for w in region:
            m = self.masks.get(w)
            if m:
                u = row & m
                row = ((row + u) | (row - u)) & full
        answer = full >> self.answer_from << self.answer_from
        tail = answer
        for w in region:
            m = self.masks.get(w, 0) & answer
            if m:
                u = tail & m
                tail = ((tail + u) | (tail - u)) & full
        held = [i for i in range(n) if not row >> i & 1]
        return ((n - row.bit_count()) / n, float(self.weights[held].sum() / self.weights.sum()),
                ((tail ^ answer) & answer).bit_count() / max(1, n - self.answer_from))


def items_of(rows: list[tuple[object, str]], idf: np.ndarray) -> list[Item]:
    """Items with words enough; the answer is the last sentence, or the last third of a single one."""
    out = []
    for item_id, text in rows:
        parts = [p for p in (text or "").replace("?", ".").replace("!", ".").replace(
            "\n", " ").split(". ") if p.strip(" .")]
        words, bounds = hashed([p.encode() for p in parts])
        if len(words) >= SHORTEST:
            last = int(bounds[-2]) if len(parts) > 1 else len(words) - max(1, len(words) // 3)
            out.append(Item(item_id, words, min(last, len(words) - 1), idf[buckets_of(words)]))
    return out


def parts_of(n: int) -> list[tuple[int, int]]:
    """First and last place of what is looked for of an item of `n` words.

    An item longer than the longest window is looked for in overlapping parts
    of that length: a window holds so little of a whole one that it is not near.
    """
    longest = SCALES[-1]
    if n <= longest:
        return [(0, n)]
    return [(at, at + longest) for at in [*range(0, n - longest, longest // 2), n - longest]]


class Searcher:
    """Windows of documents against all items of a block."""

    def __init__(self, items: list[Item], space: np.ndarray):
        self.space = np.vstack([space, np.zeros((1, space.shape[1]), np.float32)])
        self.items = items
        self.by_scale = []
        parts = [(i, a, b) for i, t in enumerate(items) for a, b in parts_of(len(t.words))]
        for i, scale in enumerate(SCALES):
            own = [(k, a) for k, a, b in parts if (i == 0 or b - a > SCALES[i - 1]) and b - a <= scale]
            if own:
                v = np.stack([space[buckets_of(items[k].words[a:a + scale])].sum(0) for k, a in own])
                v /= np.maximum(1e-9, np.linalg.norm(v, axis=1, keepdims=True))
                near = np.where([2 * len(items[k].words) < scale for k, _ in own], NEAR_SHORT, NEAR)
                self.by_scale.append((scale, own, v, near))

    def hits(self, texts: list[bytes]) -> list[tuple[int, object, float, float, float, int]]:
        """(text, item_id, cosine, share, answer share, first word), the best per text and item.

        Latent vectors are added up in blocks of BLOCK words; windows are runs
        of blocks.  Stretches of blocks bound the memory, whatever a text's
        length; windows that begin in one may reach into the next.
        """
        hashes, bounds = hashed(texts)
        numbers = buckets_of(hashes)
        sizes = -(-np.diff(bounds) // BLOCK)
        edges = np.concatenate([[0], np.cumsum(sizes)])
        text_of = np.repeat(np.arange(len(texts)), sizes)
        first = bounds[text_of] + (np.arange(len(text_of)) - edges[text_of]) * BLOCK
        found: dict[tuple[int, int], tuple] = {}
        parts: dict[tuple[int, int], list[tuple[int, float]]] = {}

        def check(t: int, i: int, low: int, high: int, cosine: float, start: int) -> None:
            item = self.items[i]
            region = item.own(hashes[max(int(bounds[t]), low):min(int(bounds[t + 1]), high)])
            if len(region) < HALF * len(item.words):  # nor can the subsequence have more
                return
            share, weight, answer = item.shares(region.tolist())
            if min(share, weight) >= WHOLE or (share >= HALF and weight >= HALF and answer >= ANSWER
                                               and len(item.words) >= PARAPHRASE):
                row = (share, answer, cosine, max(0, start - int(bounds[t])))
                if (t, i) not in found or row[:3] > found[t, i][:3]:
                    found[t, i] = row

        for begin in range(0, len(first), STRETCH):
            stop = min(len(first), begin + STRETCH)
            reach = min(len(first), stop + SCALES[-1] // BLOCK)
            places = first[begin:reach, None] + np.arange(BLOCK)
            words = np.where(places < bounds[text_of[begin:reach] + 1, None],
                             numbers[np.minimum(places, len(numbers) - 1)], BUCKETS)
            added = self.space[words[:, 0]].astype(np.float64)
            for k in range(1, BLOCK):
                added += self.space[words[:, k]]
            sums = np.zeros((reach - begin + 1, added.shape[1]))
            np.cumsum(added, axis=0, out=sums[1:])
            for scale, own, v, near_from in self.by_scale:
                step, length = max(1, scale // 3 // BLOCK), scale // BLOCK
                at = np.arange(begin, stop)
                own_text = text_of[begin:stop]
                place, left = at - edges[own_text], edges[own_text + 1] - at
                # Windows every third of their length, no more once one has reached the end.
                at = at[(place % step == 0) & ((place == 0) | (left > length - step))]
                text = text_of[at]
                upto = np.minimum(at + length, edges[text + 1])
                seen = (sums[upto - begin] - sums[at - begin]).astype(np.float32)
                seen /= np.maximum(1e-6, np.linalg.norm(seen, axis=1, keepdims=True))
                cosines = seen @ v.T
                for w, k in np.argwhere(cosines >= near_from).tolist():
                    (i, part), t = own[k], int(text[w])
                    n = len(self.items[i].words)
                    start, cosine = int(first[at[w]]), float(cosines[w, k])
                    if n > SCALES[-1]:
                        parts.setdefault((t, i), []).append((start - part, cosine))
                    else:
                        check(t, i, start - n // 2 - scale // 4,
                              start + max(scale, n) + n // 2 + scale // 4, cosine, start)
        for (t, i), places in parts.items():
            # Where the whole item would begin; places that one copy can have are one region.
            n, slack = len(self.items[i].words), SCALES[-1] // 4
            places.sort()
            while places:
                near = [p for p in places if p[0] <= places[0][0] + n // 2]
                check(t, i, near[0][0] - n // 2 - slack, near[-1][0] + n + n // 2 + slack,
                      max(c for _, c in near), near[0][0])
                places = places[len(near):]
        return [(t, self.items[i].item_id, cosine, share, answer, start)
                for (t, i), (share, answer, cosine, start) in sorted(found.items())]


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """(doc_id, item_id, cosine, lcs_share, answer_share, first_word): items found in documents.

    One row per document row and item, from the window that holds most of the
    item.  Whole texts are searched; null and empty ones hold nothing.  Items
    that are null or under SHORTEST words are not looked for.  Items are
    looked for in blocks of about ITEM_BLOCK, each a pass over the documents,
    so what tasks carry is bounded.  Empty tables give no rows.
    """
    return _contaminated(docs, benchmark, doc_id, text)[0]


def _contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id",
                  text: str = "text") -> tuple[DataFrame, Broadcast]:
    """The rows of `contaminated`, and the latent space that they are computed with."""
    kind = docs.schema[doc_id].dataType.simpleString()
    item_kind = benchmark.schema["item_id"].dataType.simpleString()
    ddl = ("doc_id %s, item_id %s, cosine double, lcs_share double, answer_share double, "
           "first_word bigint" % (kind, item_kind))
    kept = kept_passages(docs, text)
    counts = frequencies(kept)
    idf = weights_of(counts)
    space = latent_space(kept, counts)
    del kept
    shared = docs.sparkSession.sparkContext.broadcast(space)
    del space
    blocks = max(1, -(-benchmark.count() // ITEM_BLOCK))
    result = None
    for block in range(blocks):
        own = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        items = items_of([(r["item_id"], r["text"]) for r in own.select("item_id", "text").collect()], idf)

        def work(columns: dict, searcher: Searcher) -> dict:
            hits = searcher.hits(bytes_of(columns[text]))
            cols = list(zip(*hits, strict=True)) or [()] * 6
            return {"doc_id": columns[doc_id].take(pa.array(cols[0], pa.int64())),
                    **dict(enumerate(map(list, cols[1:])))}

        part = batches(docs.select(doc_id, text), work, ddl,
                       lambda items=items: Searcher(items, shared.value), text)
        result = part if result is None else result.unionByName(part)
    return result, shared


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`docs` without the documents that hold a benchmark item; a null doc_id always stays."""
    found, space = _contaminated(docs, benchmark)
    held = settle(found.select("doc_id").distinct())
    space.destroy()
    return docs.join(held, "doc_id", "left_anti").select(*docs.columns)


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, with the items."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contaminated(docs, table(spark, sf_dir, "benchmark"))
