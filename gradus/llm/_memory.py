"""What a Python worker holds between the tasks it runs."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa

#: Objects for later tasks of the same kind (a tokenizer and its table of pieces), by name.
HELD: dict[str, Any] = {}

try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library; freed memory then stays with the worker
    _trim = None


def held(name: str, make: Callable[[], Any]) -> Any:
    if name not in HELD:
        HELD[name] = make()
    return HELD[name]


def drop_others(keep: str | None) -> None:
    for name in [n for n in HELD if n != keep]:
        del HELD[name]


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keep: str | None = None):
    """``run`` for mapInArrow, which first drops what other operators' tasks held and at its end gives freed memory back to the machine.

    What is returned travels to the workers by value, so it names only functions, which each worker has of its own.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_others(keep)
        try:
            yield from run(batches)
        finally:
            give_back()

    return task
