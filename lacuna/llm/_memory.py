"""Memory of the Python workers, which later tasks and stages use again: what a task used goes back when it ends."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa


def release() -> None:
    """Give freed memory back to the system (of the C allocator only where the C library offers it)."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def uncollected(run: Callable[[Iterator[pa.RecordBatch]], Iterator]) -> Callable[[Iterator[pa.RecordBatch]], Iterator]:
    """run with the search for circular garbage off, for functions that make many small values and no circles."""

    @functools.wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator:
        was = gc.isenabled()
        gc.disable()
        try:
            yield from run(batches)
        finally:
            if was:
                gc.enable()

    return whole


def returning(run: Callable[[Iterator[pa.RecordBatch]], Iterator]) -> Callable[[Iterator[pa.RecordBatch]], Iterator]:
    """run, a function for mapInArrow, and release() after its last batch."""

    @functools.wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return whole
