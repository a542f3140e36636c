"""What a Python worker keeps, and what it gives back.

Workers outlive the stages of a session, and all that they hold stands beside the heap of their executor.
"""

from __future__ import annotations

import ctypes

import pyarrow as pa

#: Kept from task to task of one stage: by maker and arguments.
_kept: dict[tuple, object] = {}
_stage: int | None = None


def tidy() -> None:
    """Give memory that a task has freed back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def enter() -> None:
    """A task begins: what was kept for another stage is forgotten."""
    from pyspark import TaskContext

    global _stage
    task = TaskContext.get()
    now = None if task is None else task.stageId()
    if now != _stage:
        if _kept:
            _kept.clear()
            tidy()
        _stage = now


def of_stage(made, *args):
    """made(*args), kept for the tasks of the running stage."""
    enter()
    if (made, *args) not in _kept:
        _kept[(made, *args)] = made(*args)
    return _kept[(made, *args)]
