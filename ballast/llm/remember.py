"""What a Python worker remembers between batches belongs to one operator at a time.

Workers live longer than a stage.  The operator that starts to use its memory takes it over from the one before, whose
memory is emptied, so that stages that follow one another do not add up.  What a worker has freed goes back to the system as well: C's allocator
and Arrow's pool keep freed blocks for themselves, and an executor's JVM and workers share one limit.
"""
from __future__ import annotations

import ctypes

import pyarrow as pa

_owner: list[dict] = []
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's; other C libraries do without


def claim(*memories: dict) -> None:
    """Empty what another operator remembers in this worker; ``memories`` are the dictionaries in use from now on.

    A task that remembers nothing calls it once, at its begin.
    """
    if memories and [id(m) for m in _owner] == [id(m) for m in memories]:
        return
    for memory in _owner:
        if not any(memory is m for m in memories):
            memory.clear()
    _owner[:] = memories
    hand_back()


def hand_back() -> None:
    """Return freed memory to the system; at the begin of a task, what the task before held is free."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)
