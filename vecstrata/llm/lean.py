"""Memory of Python workers.

A worker outlives its task and serves the next stage.  The allocators of Arrow and
of C keep what they have once had, so a worker would hold the most that any task
before needed.  ``lean`` gives free memory back between batches.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

Batches = Iterator[pa.RecordBatch]
#: Rows that a filter looks at before it passes on those it keeps: a copy of a whole batch would be in the worker and in the JVM at once.
ROWS = 1_000


def give_back() -> None:
    """Return memory that is free to the operating system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run`` with its free memory given back after each batch that it has read and at its end."""

    def read(batches: Batches) -> Batches:
        for b in batches:
            yield b
            del b
            give_back()

    def freed(batches: Batches) -> Batches:
        yield from run(read(batches))
        give_back()

    return freed


def filtered(b: pa.RecordBatch, keep: list[bool]) -> Batches:
    """The rows of ``b`` that ``keep`` names, in small batches."""
    for at in range(0, b.num_rows, ROWS):
        yield b.slice(at, ROWS).filter(pa.array(keep[at : at + ROWS], pa.bool_()))
