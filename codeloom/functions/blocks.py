"""Arrow batches cut into blocks of bounded text, for the Arrow-backed operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

#: Rows that a block holds at most: row numbers fit in 16 bits.
BLOCK_ROWS = 1 << 15
#: Bytes of text that one NumPy block holds; one longer text is a block of its own.
BLOCK_BYTES = 1 << 21


def blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches such that ``column`` has at most about ``limit`` bytes in each."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), np.int64)
        ends = np.cumsum(sizes + 1)
        at = 0
        while at < n:
            base = ends[at - 1] if at else 0
            to = min(max(at + 1, int(np.searchsorted(ends, base + limit, side="right"))), at + BLOCK_ROWS)
            yield batch.slice(at, to - at)
            at = to


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's UTF-8 bytes without a copy, and row offsets (one more than rows)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    raw = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), raw - raw[0]
    return np.frombuffer(data, np.uint8)[raw[0] : raw[-1]], raw - raw[0]
