"""Arrow batches inside tasks."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import pyarrow as pa


def small(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, so that what a task makes of a batch of
    long texts stays small. An empty batch passes as it is. Workers live on after a task, so at
    its end what Arrow holds in reserve is given back."""
    for batch in batches:
        for start in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(start, rows)
    pa.default_memory_pool().release_unused()


def give_back() -> None:
    """Return freed memory to the machine, where the C library can. Workers idle for a minute after
    their last task, beside whatever their executor does next."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
