"""Sorted rows of a task, handed out in whole runs of equal keys."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa


def run_starts(*keys: np.ndarray) -> np.ndarray:
    """First row of each run of rows with equal keys."""
    if not len(keys[0]):
        return np.empty(0, np.int64)
    new = np.zeros(len(keys[0]), dtype=bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def whole_runs(batches: Iterable[pa.RecordBatch], n_keys: int, rows: int = 1 << 16) -> Iterator[pa.Table]:
    """Tables of at least ``rows`` rows, as far as there are, that never cut a run of equal keys.

    The first ``n_keys`` columns are whole numbers without nulls, by which the
    rows are sorted.
    """
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        table = pa.Table.from_batches(held)
        cut = int(run_starts(*(table.column(i).to_numpy() for i in range(n_keys)))[-1])
        if cut:
            yield table.slice(0, cut).combine_chunks()
            table = table.slice(cut)
            held, n = table.to_batches(), table.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
