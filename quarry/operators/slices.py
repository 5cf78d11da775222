"""Arrow batches in slices, so that what a worker makes of a batch is bounded.

A batch holds up to 10 000 rows, or as many bytes as the session allows.  A worker that turns
texts into Python objects, or lists into numpy arrays, needs many times a batch's bytes; it does
so slice by slice, and its memory depends on the slice, not on the rows or tasks of the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of text, or elements of lists, of a slice; a row that has more is a slice alone.
TEXT_BYTES = 1 << 20
ELEMENTS = 1 << 18


def _sizes(values: pa.Array) -> np.ndarray:
    measure = pc.list_value_length if pa.types.is_list(values.type) or pa.types.is_large_list(values.type) else pc.binary_length
    return np.asarray(pc.fill_null(measure(values), 0)).astype(np.int64)


def slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, in order, in parts of about ``most`` bytes or elements of ``column``."""
    ends = np.cumsum(_sizes(batch.column(column)))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def parts(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """``slices`` of all batches.  Arrow's pool keeps what is freed; it goes back to the system after
    every batch, so that a worker that waits for its next task does not hold its largest batch."""
    for batch in batches:
        yield from slices(batch, column, most)
        del batch
        pa.default_memory_pool().release_unused()


def series_slices(batches: Iterator[pd.Series], most: int) -> Iterator[pd.Series]:
    """``slices`` for the batches of a pandas function, by the lengths of their texts or lists."""
    for values in batches:
        ends = np.cumsum(np.fromiter((0 if v is None else len(v) for v in values), np.int64, len(values)))
        lo = 0
        while lo < len(values):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, side="right")))
            yield values.iloc[lo:hi]
            lo = hi
