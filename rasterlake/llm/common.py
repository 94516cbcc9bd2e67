"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..session import materialize, shared_dir, ship  # noqa: F401


def trimmed(run: Callable) -> Callable:
    """run for a task's batches, after which what it freed goes back to the system: a worker lives on and serves other stages, and its executor counts all that it holds."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # a C library without it
                pass

    return whole


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser on uint64."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_CODE = mix(np.arange(256, dtype=np.uint64))
_PLACE = mix(np.arange(1 << 12, dtype=np.uint64) + np.uint64(1 << 40)) | np.uint64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ once A-Z are lower case.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
#: Bytes of words [^\x20\x09-\x0D]+.
NONSPACE = np.ones(256, bool)
NONSPACE[9:14] = NONSPACE[32] = False


def place(n: int) -> np.ndarray:
    """A fixed odd 64-bit multiplier for each of the first n places of a word."""
    return _PLACE[:n] if n <= len(_PLACE) else mix(np.arange(n, dtype=np.uint64) + np.uint64(1 << 40)) | np.uint64(1)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all strings, and the offset of each (one more at the end). Null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of whole rows with about `most` bytes of text each, so that memory stays bounded by that and the longest text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            upto = int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right"))
            upto = max(at + 1, upto)
            yield batch.slice(at, upto - at)
            at = upto


class Words:
    """Words of a run of texts: row (index of the text), start and end (byte offsets), hash (64 bits, of the word alone)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, lower: bool = True):
        self.data = data = LOWER[data] if lower else data
        self.texts = len(offsets) - 1
        inside = kind[data]
        n = len(data)
        first = offsets[:-1][offsets[:-1] < n]
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        before[first] = False
        self.start = np.flatnonzero(inside & ~before)
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        after[first[first > 0] - 1] = False
        self.end = np.flatnonzero(inside & ~after) + 1
        self.row = (np.searchsorted(offsets, self.start, "right") - 1).astype(np.int64)
        self.count = np.bincount(self.row, minlength=self.texts).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.count)]).astype(np.int64)
        self.hash = self.hashes(np.flatnonzero(inside))

    def hashes(self, at: np.ndarray) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, np.uint64)
        length = self.end - self.start
        begin = np.cumsum(length) - length
        within = np.arange(len(at), dtype=np.int64) - np.repeat(begin, length)
        value = BYTE_CODE[self.data[at]] * place(int(length.max()))[within]
        return mix(np.add.reduceat(value, begin) ^ length.astype(np.uint64))


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive word hashes; one for each start."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j, by in enumerate(place(k)):
        total += words[j : j + n] * by
    return mix(total)
