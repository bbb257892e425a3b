"""Helpers on Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def byte_slices(batch: pa.RecordBatch, columns: list[int], size: int) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of the batch whose texts in ``columns`` have about ``size`` bytes; a longer row stands alone."""
    if not batch.num_rows:
        return
    total = np.zeros(batch.num_rows, np.int64)
    for c in columns:
        total += pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False)
    through, at = np.cumsum(total), 0
    while at < batch.num_rows:
        before = through[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(through, before + size, "right")))
        yield batch.slice(at, end - at)
        at = end


def gathered(data: bytes, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The spans of UTF-8 ``data`` as texts."""
    size = end - start
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    place = np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])
    body = np.frombuffer(data, np.uint8)[place]
    return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(body)])
