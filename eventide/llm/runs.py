"""Runs of equal keys in sorted Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Whole runs of rows with equal leading columns, from batches sorted by them; at most a run and a batch are held."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy() for i in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = np.flatnonzero(change).tolist()
        first = tuple(c[0] for c in columns)
        if held and first != last:
            yield _joined(held)
            held = []
        for start, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            if start and held:
                yield _joined(held)
                held = []
            held.append(batch.slice(start, end - start))
        last = tuple(c[-1] for c in columns)
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
