"""Whole groups out of sorted Arrow batches, without one Python call a row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of equal values in the first ``keys`` columns (integers without null) of sorted batches."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for b in batches:
        if not b.num_rows:
            continue
        columns = [np.asarray(b.column(i)) for i in range(keys)]
        new = np.zeros(b.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        new[0] = last is None or any(c[0] != x for c, x in zip(columns, last))
        starts = np.flatnonzero(new).tolist()
        if not starts:
            held.append(b)
            continue
        if starts[0]:
            held.append(b.slice(0, starts[0]))
        for lo, hi in zip(starts, [*starts[1:], b.num_rows]):
            if held:
                yield pa.Table.from_batches(held)
            held = [b.slice(lo, hi - lo)]
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)


def matrix(column: pa.ChunkedArray, dtype) -> np.ndarray:
    """Equally long lists as rows of a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(column.flatten()).astype(dtype, copy=False)
    return flat.reshape(len(column), -1)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node reachable from each of n nodes over the edges (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label
