"""Embedding vectors as exact integers, shared by centroid clustering and hard-negative mining."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Products of components up to this are summed exactly in doubles, up to 256 of them.
EXACT = 1 << 22


def integer_vectors(column: pa.Array, scale: int, dims: int | None, room: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows whose vector is kept, their components floor(scale * x) as 32-bit integers one after the other, and each kept row's length.

    Kept are vectors that are not null, without null or non-finite components,
    and with `dims` components if dims is given. Vectors so long or large that `room`
    times an inner product of two such may not fit in a long raise ValueError.
    """
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    length = np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)
    flat = pc.list_flatten(column)
    x = np.asarray(pc.fill_null(flat.cast(pa.float64()), float("nan")))
    first = np.concatenate([[0], np.cumsum(length)])
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
    keep = np.asarray(pc.is_valid(column)) & (bad[first[1:]] == bad[first[:-1]])
    if dims is not None:
        keep &= length == dims
    x = np.floor(x[np.repeat(keep, length)] * scale)
    most = int(np.abs(x).max(initial=0))
    if most >= 1 << 31 or room * int(length[keep].max(initial=0)) * most * most >= 1 << 63:
        raise ValueError(f"a component of {most / scale:g} is too large: products of such vectors don't fit in a long")
    return np.flatnonzero(keep), x.astype(np.int32), length[keep]


def as_binary(values: np.ndarray, length: np.ndarray) -> pa.Array:
    """Each row's run of 32-bit integers as bytes."""
    ends = np.concatenate([[0], np.cumsum(4 * length)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(values, "<i4").tobytes())])


def to_matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """(rows, width) components from as_binary(), shorter vectors filled with zeros; the width of the longest unless it is given."""
    length = np.asarray(pc.binary_length(column)).astype(np.int64) // 4
    width = int(length.max(initial=0)) if width is None else width
    raw = b"".join(column.to_pylist())
    flat = np.frombuffer(raw, "<i4")
    if (length == width).all():
        return flat.reshape(len(column), width)
    out = np.zeros((len(column), width), np.int32)
    out[np.arange(width) < length[:, None]] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products (rows of a, rows of b) of integer matrices as longs; columns that one of them lacks count as zeros."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    most = max(int(np.abs(a).max(initial=0)), int(np.abs(b).max(initial=0)))
    if most <= EXACT and width <= 256:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a.astype(np.int64) @ b.T.astype(np.int64)


def runs(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most `rows` rows, empty ones left out."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
