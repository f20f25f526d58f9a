"""Reading and writing Arrow batches in blocks of bounded bytes."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator
from functools import wraps

import pyarrow as pa

#: Text bytes that a block holds at least, except the last; a block is larger only by its last row.
BLOCK_BYTES = 16 << 20


def blocks(batches: Iterable[pa.RecordBatch], text: str, least_bytes: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Regroup rows into blocks by the bytes of ``text``; yields the other columns and the texts as UTF-8 (null: empty)."""
    held: list[pa.RecordBatch] = []
    texts: list[bytes] = []
    size = 0

    def out():
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0], texts

    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary())
        rest = batch.drop_columns([text])
        start = 0
        for i, value in enumerate(column.to_pylist()):
            value = value or b""
            texts.append(value)
            size += len(value)
            if size >= least_bytes:
                held.append(rest.slice(start, i + 1 - start))
                yield out()
                held, texts, size, start = [], [], 0, i + 1
        if start < len(column):
            held.append(rest.slice(start))
    if texts:
        yield out()


def with_columns(rest: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*rest.columns, *columns.values()], names=[*rest.schema.names, *columns])


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run``, after which the worker gives its free memory back: workers outlive their tasks, next to whatever runs then."""

    @wraps(run)
    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except OSError:  # another C library
            pass

    return out
