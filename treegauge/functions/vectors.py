"""Similarity of vectors.  One Arrow batch is one matrix product."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType


def cosine_to(vector: Column, query: list[float]) -> Column:
    """Cosine of a vector column with one query vector (a parameter).

    The query is captured by the function, so it is sent once per task rather
    than once per row.
    """
    wanted = np.asarray(query, dtype="f8")
    scale = float(np.sqrt((wanted * wanted).sum()))

    @F.arrow_udf(DoubleType())
    def scored(batch: pa.Array) -> pa.Array:
        n = len(batch)
        if n == 0:
            return pa.array([], pa.float64())
        flat = batch.flatten().to_numpy(zero_copy_only=False).astype("f8")
        if flat.size != n * wanted.size:
            raise ValueError("vectors hold %d values, not %d x %d"
                             % (flat.size, n, wanted.size))
        matrix = flat.reshape(n, -1)
        norms = np.sqrt((matrix * matrix).sum(1)) * scale
        return pa.array(np.divide(matrix @ wanted, norms,
                                  out=np.zeros(n), where=norms > 0))

    return scored(vector)


def mulberry32(call: Column, seed: int) -> Column:
    """The `call`-th value (from 1) of the seeded 32-bit generator.

    The generator's state is a counter, so each value is a function of its
    index: arithmetic modulo 2**32 on 64-bit integers.
    """
    mask = F.lit(0xFFFFFFFF)

    def imul(a: Column, b: Column) -> Column:
        low = a.bitwiseAND(F.lit(0xFFFF))
        high = F.shiftrightunsigned(a, 16)
        return (low * b + F.shiftleft((high * b).bitwiseAND(F.lit(0xFFFF)), 16)
                ).bitwiseAND(mask)

    a = (F.lit(seed) + (call.cast("bigint") * F.lit(0x6D2B79F5))).bitwiseAND(mask)
    t = imul(a.bitwiseXOR(F.shiftrightunsigned(a, 15)), a.bitwiseOR(F.lit(1)))
    t = t.bitwiseXOR((t + imul(t.bitwiseXOR(F.shiftrightunsigned(t, 7)),
                               t.bitwiseOR(F.lit(61)))).bitwiseAND(mask))
    return t.bitwiseXOR(F.shiftrightunsigned(t, 14)) / F.lit(4294967296.0)
