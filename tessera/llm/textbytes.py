"""Arrow string columns as flat NumPy byte arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Documents are handled in runs of about so many bytes, so that memory follows this and the longest text.
RUN_BYTES = 1 << 20


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls count as empty."""
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    width = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(column: pa.Array, run_bytes: int = RUN_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows of about ``run_bytes`` together."""
    data, offsets = flat(column)
    n, start = len(offsets) - 1, 0
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + run_bytes, "right")) - 1)
        part = offsets[start : end + 1]
        yield start, end, data[part[0] : part[-1]], part - part[0]
        start = end


def per_document(values: np.ndarray, starts: np.ndarray, ufunc=np.add) -> np.ndarray:
    """reduceat over [starts[i], starts[i+1]) with 0 for empty spans; ``starts`` has one more entry than documents."""
    out = np.zeros((len(starts) - 1, *values.shape[1:]), values.dtype)
    full = np.flatnonzero(np.diff(starts) > 0)
    if len(full):
        out[full] = ufunc.reduceat(values, starts[full], axis=0)
    return out
