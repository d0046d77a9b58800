"""Streaming the rows of bounded groups through Arrow tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa


def by_first_column(batches: Iterator[pa.RecordBatch], each: Callable[[pa.Table], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Calls ``each`` with all rows of every value of the first column; the rows come sorted by it."""
    open_key, parts = None, []
    for batch in batches:
        key = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if lo == hi:
                continue
            if parts and key[lo] != open_key:
                yield each(pa.Table.from_batches(parts))
                parts = []
            open_key = key[lo]
            parts.append(batch.slice(lo, hi - lo))
    if parts:
        yield each(pa.Table.from_batches(parts))


def many(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The batches joined to tables of about ``rows`` rows: what is small is worked on together."""
    parts, n = [], 0
    for batch in batches:
        parts.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(parts)
            parts, n = [], 0
    if parts:
        yield pa.Table.from_batches(parts)
