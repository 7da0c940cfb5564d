"""Texts as bytes in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that numpy works on at once, so that a task's memory doesn't follow the batch size.
SLICE_BYTES = 1 << 20


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), offsets


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with at most `limit` bytes of text, or of one row."""
    _, offsets = raw(batch.column(column))
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + limit, "right")) - 1)
        yield batch.slice(begin, end - begin)
        begin = end


def encoded(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each row; null counts as empty."""
    data, offsets = raw(column)
    whole = memoryview(data)
    return [bytes(whole[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def words(text: bytes) -> list[bytes]:
    """Maximal runs of bytes that are none of space, tab, line feed, vertical tab, form feed and carriage return."""
    return text.split()
