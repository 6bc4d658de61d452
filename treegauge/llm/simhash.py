"""SimHash near-duplicates by a grid over per-segment bit counts.

A fingerprint of 64 bits is embedded as 32 coordinates, the bit counts of its
segments of two bits.  One differing bit moves one coordinate by at most one,
so the Manhattan distance of two embeddings is at most the number of differing
bits: a lower bound.  Fingerprints within `distance` bits are found by a range
join on a grid over this embedding and verified exactly.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from treegauge.joins import lookup

from .common import batches, bytes_of, settle, table
from .components import components

#: Two-bit segments of a fingerprint.
SEGMENTS = 32
#: A cell with more fingerprints is linked through shared points instead of pairs.
CROWD = 64
#: Narrow keys that are broadcast at most.
FEW = 1_000_000

_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
#: Bits of every byte value, least first.
_BITS = (np.arange(256)[:, None] >> np.arange(8)) & 1


def shingles(text: bytes, width: int) -> np.ndarray:
    """Hashes of all runs of `width` words, or of a shorter text's words together."""
    from xxhash import xxh64_intdigest

    words = text.translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) < width:
        starts, ends = starts[:1], ends[-1:]
    else:
        starts, ends = starts[:len(words) - width + 1], ends[width - 1:]
    return np.fromiter((xxh64_intdigest(joined[a:b], 42)
                        for a, b in zip(starts.tolist(), ends.tolist(), strict=True)),
                       np.uint64, len(starts))


def sketch(hashes: np.ndarray) -> int:
    """Bit 1 where over half of the hashes have it, as a signed long; 0 without hashes."""
    n = len(hashes)
    counts = np.zeros((8, 256), np.int64)
    for block in range(0, n, 1 << 18):
        lanes = hashes[block:block + (1 << 18)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.bincount((lanes + np.arange(0, 2048, 256)).ravel(),
                              minlength=2048).reshape(8, 256)
    bits = (counts @ _BITS).ravel() * 2 > n
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprint(text: bytes, width: int) -> int:
    """The SimHash of one text; bit 1 where over half of the shingle hashes have it."""
    return sketch(shingles(text, width))


def fingerprints(docs: DataFrame, width: int, doc_id: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint of each whole text as a signed long.

    Null and empty texts, and those of white space alone, have fingerprint 0.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def work(columns: dict) -> dict:
        return {"doc_id": columns[doc_id],
                "fp": np.array([fingerprint(t, width) for t in bytes_of(columns[text])],
                               np.int64)}

    return batches(docs.select(doc_id, text), work, "doc_id %s, fp bigint" % kind, text=text)


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def embedding(fp: Column) -> Column:
    """The bit counts of the 32 segments, two bits each, in one long."""
    odd = F.lit(0x5555555555555555)
    # fp - (odd bits of fp): no borrow crosses a segment; 64-bit wrap-around is wanted.
    high = F.shiftrightunsigned(fp, 1).bitwiseAND(odd)
    low = fp.bitwiseAND(odd)
    both = low.bitwiseAND(high)  # count 2
    one = low.bitwiseXOR(high)   # count 1
    return F.shiftleft(both, 1).bitwiseOR(one)


def manhattan(v: Column, w: Column) -> Column:
    """Manhattan distance of two embeddings: counts 0 and 2 differ by two, others by one."""
    odd = F.lit(0x5555555555555555)
    x = v.bitwiseXOR(w)
    low = x.bitwiseAND(odd)
    high = F.shiftrightunsigned(x, 1).bitwiseAND(odd)
    return F.bit_count(low) + 2 * F.bit_count(high.bitwiseAND(F.bitwise_not(low)))


def cells(distance: int) -> list[int]:
    """Masks of the coordinates that name a cell; the others have their whole range.

    The coordinates form `distance + 4` groups.  A Manhattan distance of at
    most `distance` leaves at least four groups equal, so two such embeddings
    share the cell of one of the masks.
    """
    groups = distance + 4
    edges = [2 * (SEGMENTS * i // groups) for i in range(groups + 1)]
    own = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(groups)]
    return [signed(sum(own[i] for i in kept)) for kept in combinations(range(groups), 4)]


def links(classes: DataFrame, distance: int, crowd: int = CROWD) -> DataFrame:
    """(a, b): edges over different fingerprints `fp`, enough to connect all within `distance`.

    Cells of up to `crowd` fingerprints are range-joined pair by pair.  In a
    fuller cell pairs would grow with its square, so its fingerprints are
    linked through points exactly (`through_points`); nothing is dropped.
    """
    masks = cells(distance)
    placed = classes.select("fp", embedding(F.col("fp")).alias("v")).select(
        "fp", "v", F.explode(F.array(*[
            F.struct(F.lit(i).alias("m"), F.col("v").bitwiseAND(F.lit(mask)).alias("c"))
            for i, mask in enumerate(masks)])).alias("cell")).select("fp", "v", "cell.*")
    sizes = placed.groupBy("m", "c").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = settle(lookup(placed, sizes, ["m", "c"], "inner"))
    calm = shared.where(F.col("n") <= crowd)
    other = calm.select("m", "c", F.col("fp").alias("fp2"), F.col("v").alias("v2"))
    near = calm.join(other, ["m", "c"]).where(
        (F.col("fp") > F.col("fp2"))
        & (manhattan(F.col("v"), F.col("v2")) <= distance)
        & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= distance))
    pairs = near.select(F.col("fp").alias("a"), F.col("fp2").alias("b")).distinct()
    crowded = shared.where(F.col("n") > crowd).select("fp").distinct()
    return pairs.unionByName(through_points(crowded, distance))


def ball(radius: int) -> list[int]:
    """All masks of at most `radius` bits."""
    return [signed(sum(1 << i for i in bits)) for n in range(radius + 1)
            for bits in combinations(range(64), n)]


def through_points(members: DataFrame, distance: int) -> DataFrame:
    """(a, b): each fingerprint and the least one it meets at a point between.

    Two fingerprints within `distance` have a point within distance // 2 of
    one and the rest of the other.  All that meet at a point with one that is
    as near as distance // 2 are within `distance` of that one, so a star per
    point connects the same fingerprints as all pairs do, and its edges grow
    with the members.
    """
    near, far = distance // 2, distance - distance // 2
    inner = len(ball(near))
    steps = F.array(*[F.lit(m) for m in ball(far)])
    reached = members.select("fp", F.posexplode(steps).alias("i", "step")).select(
        "fp", (F.col("i") < inner).alias("inner"),
        F.col("fp").bitwiseXOR(F.col("step")).alias("point"))
    stars = reached.groupBy("point").agg(
        F.min(F.when(F.col("inner"), F.col("fp"))).alias("b"),
        F.count(F.lit(1)).alias("n")).where("n > 1 and b is not null").drop("n")
    return lookup(reached, stars, ["point"], "inner").where("fp <> b").select(
        F.col("fp").alias("a"), "b").distinct()


def near_duplicates(docs: DataFrame, width: int, distance: int, doc_id: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): the least doc_id that links reach from each document.

    Copies share a fingerprint and count once in the links; only the last
    join meets all documents, and splits a fingerprint that a third of them
    share.  A null doc_id never names a component: a component of such rows
    alone has none.  Repeated rows are copies.  No rows give no rows.
    """
    found = settle(fingerprints(docs, width, doc_id, text))
    classes = settle(found.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(classes, distance)).select(F.col("node").alias("fp"), "root")
    named = settle(lookup(classes, roots, ["fp"]).select(
        "fp", "least", F.coalesce("root", "fp").alias("root")))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    known = lookup(named.drop("least"), least, ["root"]).drop("root")
    return lookup(found, known, ["fp"])


def keep_one(docs: DataFrame, width: int, distance: int) -> DataFrame:
    """`docs` with one document of each component, the one with the least doc_id.

    A row without doc_id cannot be named as a copy and stays.  Rows that
    repeat a kept doc_id stay once.
    """
    return _least_of(docs, settle(near_duplicates(docs, width, distance)))


def narrowed(rows: DataFrame, keys: DataFrame, on: list[str], how: str) -> DataFrame:
    """`rows` semi or anti joined with settled `keys`: broadcast up to FEW of them, else shuffled.

    The keys are few columns; where they may be broadcast, wide rows stay where they are.
    """
    return rows.join(F.broadcast(keys) if keys.count() <= FEW else keys, on, how)


def _least_of(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Whole rows go only by their doc_id: what is decided, counted and joined is narrow."""
    own = found.where(F.col("doc_id").isNotNull())
    ids = own.groupBy("doc_id").agg(
        F.max(F.col("doc_id") == F.col("component_id")).alias("kept"), F.count(F.lit(1)).alias("times"))
    ids = settle(ids.where("not kept or times > 1"))
    columns = [F.col("`%s`" % c.replace("`", "``")) for c in docs.columns]
    stay = narrowed(docs, ids.where("not kept").select("doc_id"), ["doc_id"], "left_anti")
    again = ids.where("kept").select("doc_id")
    if again.isEmpty():
        return stay.select(*columns)
    once = narrowed(stay, again, ["doc_id"], "left_anti").select(*columns)
    return once.unionByName(narrowed(stay, again, ["doc_id"], "left_semi").dropDuplicates(["doc_id"])
                            .select(*columns))


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs, 3, 2).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
