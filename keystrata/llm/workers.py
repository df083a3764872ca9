"""Memory of Python workers, which Spark keeps from task to task and uses for one operator after the other.

What a module keeps between tasks (caches) is forgotten when a worker begins to work for another operator, and
what numpy and Arrow have freed goes back to the system at the end of every task.
"""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable

import pyarrow as pa

_owner: list[str] = [""]
_forget: list[Callable[[], None]] = []


def keeps(forget: Callable[[], None]) -> None:
    """Registers what empties a module's caches."""
    _forget.append(forget)


def release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # a C library without it
        pass


def works_for(owner: str) -> None:
    if _owner[0] != owner:
        if _owner[0]:
            for forget in _forget:
                forget()
            gc.collect()
            release()
        _owner[0] = owner


def task(owner: str):
    """Decorates a function of record batches for mapInArrow."""

    def around(run):
        @functools.wraps(run)
        def inner(batches, *args, **named):
            works_for(owner)
            try:
                yield from run(batches, *args, **named)
            finally:
                release()

        return inner

    return around


def group(owner: str):
    """Decorates a function of a table for applyInArrow."""

    def around(run):
        @functools.wraps(run)
        def inner(table):
            works_for(owner)
            out = run(table)
            if table.nbytes >= 4 << 20:
                del table
                release()
            return out

        return inner

    return around
