"""Best-fit packing certified by lower bounds.

Pieces are dealt into partitions and each is packed best-fit decreasing.  Dual
feasible functions bound from below how few sequences a partition could use.
Where sequences stay unfilled, their pieces are exchanged: they are dealt
anew into as many partitions as they still need and packed again, until the
total meets the bound of all pieces, one partition holds what is left, or no
sequence can be filled.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import batches, settle, table, texts_of
from .pieces import loaded

#: A partition of the packing holds about so many tokens and at most so many pieces.
PARTITION_TOKENS = 16 << 20
PARTITION_PIECES = 200_000
#: Times that unfilled sequences are exchanged at most; every round keeps all pieces.
ROUNDS = 8


def pieces(docs: DataFrame, path: str, capacity: int, end: int, doc_id: str = "doc_id",
           text: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], deal): token pieces of every document.

    A document is the ids of its text and then `end`; longer ones than
    `capacity` are cut, shorter ones are one piece.  A null or empty text is
    the one id `end`.  `deal` spreads the pieces evenly whatever their ids
    are: repeated and null doc_ids are rows like any other.
    """
    id_type = docs.schema[doc_id].dataType.simpleString()
    schema = ("doc_id %s, piece int, start bigint, length bigint, ids_crc32 bigint, deal bigint"
              % id_type) + (", ids array<int>" if with_ids else "")

    class Task:
        """The worker's tokenizer and how many pieces this task has dealt."""

        def __init__(self) -> None:
            from pyspark import TaskContext

            context = TaskContext.get()
            self.known = loaded(path, keep_ids=True)
            self.dealt = context.partitionId() if context else 0
            self.rest = self.known.rest

    def work(columns: dict, task: Task) -> dict:
        known = task.known
        texts = texts_of(columns[text])
        words = [lone_words(t) for t in texts]
        numbers = known.numbers([w for own in words for w in own])
        flat = known.flat(numbers)
        edges = np.concatenate([[0], np.cumsum(known.lengths[numbers])])
        bounds = edges[np.concatenate([[0], np.cumsum([len(own) for own in words])])]
        out = {n: [] for n in ("row", "piece", "start", "length", "crc", "ids")}
        for row in range(len(texts)):
            ids = np.append(flat[bounds[row]:bounds[row + 1]], np.uint32(end)).astype("<u4")
            for number, start in enumerate(range(0, len(ids), capacity)):
                part = ids[start:start + capacity]
                out["row"].append(row)
                out["piece"].append(number)
                out["start"].append(start)
                out["length"].append(len(part))
                out["crc"].append(zlib.crc32(part.tobytes()))
                if with_ids:
                    out["ids"].append(part.astype(np.int32))
        n = len(out["row"])
        # A walk by the golden ratio from a start of the task's own.
        steps = (np.arange(n, dtype=np.uint64) + np.uint64(task.dealt)) * np.uint64(
            0x9E3779B97F4A7C15)
        task.dealt += n + 7919
        made = {"doc_id": columns[doc_id].take(pa_indices(out["row"])), "piece": out["piece"],
                "start": out["start"], "length": out["length"], "crc": out["crc"],
                "deal": (steps >> np.uint64(1)).astype(np.int64)}
        return {**made, "ids": out["ids"]} if with_ids else made

    return batches(docs.select(doc_id, text), work, schema, Task, text)


#: A full stop or comma between a letter and white space is a piece of its own.
_STOP = re.compile(r"(?<=[a-z])([.,])(?=[ \n])")
_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))


def lone_words(text: str) -> list[str]:
    """Pieces of a text for a tokenizer that folds case and drops white space.

    It cuts at white space and between letters and other marks anyway, and
    special strings, whose case counts, hold "<|".
    """
    if "<|" not in text:
        text = _STOP.sub(r" \1", text.encode().translate(_LOWER).decode())
    return text.replace("\n", " ").split(" ")


def pa_indices(rows: list[int]):
    import pyarrow as pa

    return pa.array(rows, pa.int64())


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: the best of several dual feasible functions.

    Such a function f keeps sum f <= 1 wherever sum of sizes <= 1, so the sum
    of f over all pieces bounds the bins.  Used are the identity; the
    threshold functions (over 1 - t counts whole, under t counts nothing);
    and the rounding functions x -> floor((k + 1) x) / k, which keep x where
    (k + 1) x is whole.
    """
    return bound_of(np.bincount(lengths, minlength=capacity + 1), capacity)


def bound_of(count: np.ndarray, capacity: int) -> int:
    """The same from the number of pieces of each length, 0 to `capacity`."""
    count = count.astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((count * size).sum()) // capacity)
    below = np.cumsum(count)
    weight = np.cumsum(count * size)
    t = np.arange(1, capacity // 2 + 1)
    whole = below[capacity] - below[capacity - t]
    middle = weight[capacity - t] - weight[t - 1]
    best = max(best, int((whole + -(-middle // capacity)).max(initial=0)))
    for k in range(1, 33):
        scaled = (k + 1) * size
        rounded = np.where(scaled % capacity == 0, size * k, scaled // capacity * capacity)
        best = max(best, -(-int((count * rounded).sum()) // (k * capacity)))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each piece and the fill of each bin: the longest first, each into the
    fullest bin that takes it.  Ties fall to the earlier row."""
    order = np.argsort(-lengths, kind="stable")
    bins = np.zeros(len(lengths), np.int64)
    offsets = np.zeros(len(lengths), np.int64)
    fill: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has room r
    for row, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            target = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, target = capacity, len(fill)
            fill.append(0)
        bins[row], offsets[row] = target, fill[target]
        fill[target] += n
        left = room - n
        if left:
            by_room[left].append(target)
            rooms |= 1 << left
    return bins, offsets, np.array(fill, np.int64)


def pack(found: DataFrame, capacity: int, length: str = "length", deal: str = "deal",
         ) -> DataFrame:
    """`found` with (sequence_id, offset) instead of `deal`.

    Every row is placed once; offsets are gapless from 0.  Lengths are 1 to
    `capacity`.  An empty table gives an empty one.  Equal lengths and
    repeated rows are packed one by one.  Filled sequences are final; the
    others are exchanged while the bound of all pieces is not met.
    """
    found = settle(found.drop("sequence_id", "offset", "_bucket", "_fill", "_bins", "_bound"))
    columns = [c for c in found.columns if c != deal]
    counts = found.groupBy(F.col(length).alias("n")).agg(F.count(F.lit(1)).alias("times"))
    if not counts.where(F.col("n") > capacity).isEmpty():
        raise ValueError("a piece is longer than a sequence")
    # At most one row for each length up to the capacity.
    times = np.zeros(capacity + 1, np.int64)
    for row in counts.collect():
        times[row["n"]] = row["times"]
    least = bound_of(times, capacity)
    out = StructType([found.schema[c] for c in columns]
                     + [StructField("sequence_id", LongType()), StructField("offset", LongType())])

    def placed(rows: DataFrame, number: int, buckets: int) -> DataFrame:
        def work(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values([deal, length], kind="stable").reset_index(drop=True)
            lengths = group[length].to_numpy(np.int64)
            bins, offsets, fill = best_fit(lengths, capacity)
            bucket = int(group["_bucket"].iloc[0])
            group["sequence_id"] = (number << 56) + (bucket << 26) + bins
            group["offset"] = offsets
            group["_fill"] = fill[bins]
            group["_bins"] = 0
            group["_bound"] = 0
            group.loc[0, ["_bins", "_bound"]] = len(fill), lower_bound(lengths, capacity)
            return group

        dealt = rows.withColumn("_bucket", F.pmod(F.col(deal), F.lit(buckets)))
        schema = StructType(dealt.schema.fields + [
            StructField(n, LongType()) for n in
            ("sequence_id", "offset", "_fill", "_bins", "_bound")])
        return settle(dealt.groupBy("_bucket").applyInPandas(work, schema)).drop("_bucket")

    # A piece that fills a sequence is a sequence.
    whole = found.where(F.col(length) == capacity).select(
        *columns, F.monotonically_increasing_id().alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"))
    done, used = [whole], int(times[capacity])
    rest = found.where(F.col(length) < capacity)
    rows, tokens = int(times[:capacity].sum()), int((times * np.arange(capacity + 1))[:capacity].sum())
    for number in range(1, ROUNDS + 1):
        if not rows:
            break
        buckets = max(1, -(-tokens // PARTITION_TOKENS), -(-rows // PARTITION_PIECES))
        result = placed(rest, number, buckets)
        full = F.col("_fill") == capacity
        report = result.agg(F.sum("_bins").alias("bins"), F.sum("_bound").alias("bound"),
                            F.count_if(full & (F.col("offset") == 0)).alias("full"),
                            F.count_if(~full).alias("rows"),
                            F.sum(F.when(~full, F.col(length))).alias("tokens")).first()
        keep = result.select(*columns, "sequence_id", "offset", "_fill")
        # Certified: one partition at its bound, or all of them at the bound of all pieces.
        certified = used + report["bins"] == least or buckets == 1 and report["bins"] == report["bound"]
        if certified or buckets == 1 or not report["full"] or number == ROUNDS:
            done.append(keep.drop("_fill"))
            break
        done.append(keep.where(full).drop("_fill"))
        used += report["full"]
        # Exchange: pieces of unfilled sequences are dealt anew among as many partitions as they need.
        rest = result.where(~full).select(*columns, F.xxhash64(deal, F.lit(number)).alias(deal))
        rows, tokens = report["rows"], report["tokens"] or 0
    packed = done[0]
    for part in done[1:]:
        packed = packed.unionByName(part)
    return packed if times.any() else found.sparkSession.createDataFrame([], out)


def sequences(found: DataFrame, capacity: int) -> DataFrame:
    """(sequence_id, ids, doc_ids) of pieces packed with their ids: the sequences themselves.

    A group holds at most `capacity` ids.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return found.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id", F.flatten(F.col("p.ids")).alias("ids"), F.col("p.doc_id").alias("doc_ids"))


def op9_packing(spark, sf_dir: str) -> DataFrame:
    """Every document in sequences of at most 4096 tokens, one row per piece."""
    return packed_documents(table(spark, sf_dir, "documents"))


def packed_documents(docs: DataFrame, capacity: int = 4096, end: int = 1) -> DataFrame:
    import public_tokenizers

    found = pieces(docs, public_tokenizers.path("word_bpe_49k.json"), capacity, end)
    return pack(found, capacity)
