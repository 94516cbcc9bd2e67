"""Groups of rows inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa


def whole_groups(batches: Iterator[pa.RecordBatch], key: list[str], work: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """work(batch, edges) for rows in order of key (integers), cut so that no group is parted; edges are the groups' first rows and the number of rows. Holds one group besides a batch."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        values = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in key])
        edges = np.flatnonzero(np.append(True, (values[:, 1:] != values[:, :-1]).any(axis=0)))
        if len(edges) > 1:
            yield work(batch.slice(0, int(edges[-1])), edges)
        held = batch.slice(int(edges[-1]))
    if held is not None:
        yield work(held, np.array([0, held.num_rows]))
