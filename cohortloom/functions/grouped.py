"""Grouped work in Python over whole batches: many small groups per call instead of one call per group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def change_points(columns: list[np.ndarray]) -> np.ndarray:
    """Positions at which a group starts, for rows sorted by the given columns."""
    n = len(columns[0])
    if not n:
        return np.zeros(0, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 65_536) -> Iterator[pa.Table]:
    """Tables of whole groups of at least ``rows`` rows, from batches sorted by ``keys``.

    Only the group that a batch ends in is carried into the next table, so memory is bounded by ``rows``
    plus the largest group.
    """
    hold: list[pa.RecordBatch] = []
    held = 0
    for b in batches:
        if b.num_rows:
            hold.append(b)
            held += b.num_rows
        if held < rows:
            continue
        t = pa.Table.from_batches(hold)
        last = change_points([t.column(k).to_numpy(zero_copy_only=False) for k in keys])[-1]
        if last:
            yield t.slice(0, last)
            rest = t.slice(last)
            hold, held = rest.combine_chunks().to_batches(), rest.num_rows
        else:
            rows = max(rows, 2 * held)
    if held:
        yield pa.Table.from_batches(hold)


def map_groups(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    work: Callable[[pa.Table], pa.RecordBatch | pa.Table | Iterator[pa.RecordBatch] | None],
    schema: str,
    rows: int = 65_536,
) -> DataFrame:
    """Shuffle by ``keys``, sort by keys and ``order`` in the JVM, and give ``work`` tables of whole groups.

    The keys must not be null. A group goes to one task: callers bound its size by aggregating before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, keys, rows):
            out = work(t)
            if isinstance(out, pa.Table):
                yield from out.to_batches(max_chunksize=65_536)
            elif isinstance(out, pa.RecordBatch):
                yield out
            elif out is not None:
                yield from out

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
