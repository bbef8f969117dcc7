"""Arrow batches in and out of Python tasks, in pieces of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 19


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose ``column`` holds about ``limit`` bytes or items, or one row that is longer."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        values = batch.column(column)
        measure = pc.list_value_length if pa.types.is_list(values.type) else pc.binary_length
        totals = np.cumsum(measure(values).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = totals[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(totals, before + limit, side="right")))
            yield batch.slice(start, end - start)
            start = end
