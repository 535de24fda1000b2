"""What the operators share: Arrow buffers as numpy arrays, slices of batches."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

#: Bytes of text that a numpy step handles at once.
CHUNK_BYTES = 4 << 20


def text_bytes(name: str = "text"):
    """The whole text as UTF-8; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")


def binary_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls, end to end, and where each row begins (one more offset than rows)."""
    column = column.cast(pa.large_binary()) if column.type != pa.large_binary() else column
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch of about limit bytes of one binary column, each with that column's bytes and offsets; a longer row comes alone."""
    at = batch.schema.get_field_index(column)
    _, offsets = binary_parts(batch.column(at))
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + limit, "right")) - 1)
        part = batch.slice(begin, end - begin)
        yield (part, *binary_parts(part.column(at)))
        begin = end


def long_array(column: pa.Array, null: int = 0) -> np.ndarray:
    return column.fill_null(null).to_numpy(zero_copy_only=False).astype(np.int64, copy=False) if column.null_count else column.to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def binary_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column from bytes and offsets. Spark holds at most 2 GB in a value, so more than that is an error."""
    if len(data) >= 2**31:
        raise ValueError("more than 2 GB for one column of a batch")
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def released(results: Iterator) -> Iterator:
    """The results one by one; after each, and at the end, memory that is free goes back to the system, so that workers that live on stay small."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)
    for result in results:
        yield result
        del result
        pa.default_memory_pool().release_unused()
        trim(0)
    pa.default_memory_pool().release_unused()
    trim(0)


def rows_schema(**fields: pa.DataType) -> pa.Schema:
    return pa.schema([pa.field(k, v) for k, v in fields.items()])
