"""Small helpers for functions over Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a function holds at once beyond its longest document.
SLICE_BYTES = 2 << 20


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``limit`` bytes of text (at least
    one row).  A null text becomes empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        i = batch.schema.get_field_index(text)
        filled = pc.fill_null(batch.column(i).cast(pa.string()), "")
        batch = batch.set_column(i, text, filled)
        ends = np.cumsum(pc.binary_length(filled).to_numpy(zero_copy_only=False).astype(np.int64))
        a, base = 0, 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(a, b - a)
            a, base = b, int(ends[b - 1])


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column without nulls, joined, and the row offsets."""
    column = column.cast(pa.string())
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return buf, off - off[0]


def record(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def give_back() -> None:
    """Freed memory goes back to the machine; else a worker keeps what it ever held."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run):
    """A task's function that gives memory back at its end."""
    def tidied(batches):
        yield from run(batches)
        give_back()
    return tidied
