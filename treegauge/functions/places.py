"""Where terms stand in searchable forms, for all rows of an Arrow batch at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text whose tokens are held at once.
STRETCH = 4 << 20


def stretches(batch: pa.RecordBatch, *columns: str) -> list[pa.RecordBatch]:
    """The rows of a batch in runs of about STRETCH bytes of the named columns."""
    size = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy().astype(np.int64) for c in columns)
    part = np.cumsum(size) // STRETCH
    edges = np.append(np.flatnonzero(np.diff(part, prepend=-1)), batch.num_rows).tolist()
    return [batch.slice(a, b - a) for a, b in zip(edges, edges[1:])]


def _tokens(forms: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All tokens of all forms, with their row and their number in it."""
    lists = pc.split_pattern(forms, "  ")
    values = lists.flatten()
    rows = np.repeat(np.arange(len(forms)), pc.list_value_length(lists).to_numpy())
    real = pc.not_equal(values, "")
    rows = rows[real.to_numpy(zero_copy_only=False)]
    first = np.searchsorted(rows, np.arange(len(forms)))
    return values.filter(real), rows, np.arange(len(rows)) - first[rows]


def places(t: pa.Array, s: pa.Array, only: pa.Array | None = None,
           ) -> tuple[pa.Array, np.ndarray, np.ndarray, pa.Array, pa.Array]:
    """`terms, code, row, t, s`: per term and row that holds it, its positions in both forms.

    In the order of `code` (the number of the term in `terms`), then of `row`.
    `only` names the terms that are wanted.
    """
    sides = [_tokens(t), _tokens(s)]
    coded = pa.concat_arrays([values for values, _, _ in sides]).dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.int64)
    wanted = np.ones(len(coded.dictionary), bool) if only is None else pc.is_in(
        coded.dictionary, value_set=only.cast(coded.dictionary.type)).to_numpy(zero_copy_only=False)
    rows_in_all = max(1, len(t))
    keys, positions, at = [], [], 0
    for values, rows, pos in sides:
        own = codes[at:at + len(values)]
        at += len(values)
        kept = wanted[own]
        key, pos = (own * rows_in_all + rows)[kept], pos[kept]
        order = np.argsort(key, kind="stable")
        keys.append(key[order])
        positions.append(pos[order].astype(np.int32))
    pairs = np.union1d(*keys)
    lists = [pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(key, pairs), len(key)).astype(np.int32)),
                                      pa.array(pos)) for key, pos in zip(keys, positions, strict=True)]
    return coded.dictionary, pairs // rows_in_all, pairs % rows_in_all, *lists
