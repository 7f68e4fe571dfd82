"""Python workers outlive their tasks: what a task used goes back to the system."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa


def release() -> None:
    """Free what is unreferenced, and return free memory of Arrow's and C's allocators."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, a function over a task's batches, followed by ``release``."""

    @wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        release()

    return wrapped
