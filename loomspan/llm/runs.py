"""Groups of rows as runs in a sorted stream, for many small groups: no call and no table for each.

A task holds one batch and the run at its end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .store import partitions


def together(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of equal keys in one partition, one after the other."""
    return df.repartition(partitions(df.sparkSession), *keys).sortWithinPartitions(*keys)


def whole(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole runs of rows with equal keys from a stream in which such rows stand together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = [batch.column(c)[batch.num_rows - 1].as_py() for c in keys]
        same = np.ones(batch.num_rows, bool)
        for c, x in zip(keys, last, strict=True):
            same &= np.asarray(batch.column(c)) == x
        cut = batch.num_rows if not same.any() else int(np.argmax(same))
        if cut or (held and [held[-1].column(c)[held[-1].num_rows - 1].as_py() for c in keys] != last):
            whole = [*held, batch.slice(0, cut)]
            held = []
            if sum(b.num_rows for b in whole):
                yield pa.Table.from_batches(whole)
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def bounds(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Bounds of the runs of equal keys."""
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for c in keys:
        x = np.asarray(table.column(c))
        new[1:] |= x[1:] != x[:-1]
    return np.append(np.flatnonzero(new), table.num_rows)
