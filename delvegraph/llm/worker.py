"""What a Python worker holds between tasks: the memory of one operator at a time."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable
from typing import Any

_OWNER: str | None = None
_HELD: dict[Any, Any] = {}


def trim() -> None:
    """Give freed memory back, as a worker that waits for its next task should hold little."""
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def enter(owner: str) -> None:
    """Drop what another owner left in this worker."""
    global _OWNER
    if owner != _OWNER:
        _HELD.clear()
        _OWNER = owner
        trim()


def tidy(owner: str) -> Callable:
    """For a function over a task's batches: enter as ``owner``, and trim at the end."""

    def around(run: Callable) -> Callable:
        @functools.wraps(run)
        def task(*args, **kwargs):
            enter(owner)
            try:
                yield from run(*args, **kwargs)
            finally:
                trim()

        return task

    return around


def hold(owner: str, key: tuple, make: Callable[[], Any]) -> Any:
    """``make()`` for ``key``, kept for the owner's next tasks in this worker.

    Another owner's things are dropped first, and so is an older thing of the same
    kind (the key's first part), so that a worker that serves stage after stage and
    run after run never holds more than one operator's memory.
    """
    enter(owner)
    if key not in _HELD:
        for old in [k for k in _HELD if k[0] == key[0]]:
            del _HELD[old]
        _HELD[key] = make()
    return _HELD[key]


@functools.cache
def one_thread() -> None:
    """Let numpy's products run in the task's own thread: tasks share the cores already."""
    import glob
    import os

    import numpy as np

    for path in glob.glob(os.path.join(os.path.dirname(np.__file__), "..", "numpy.libs", "*openblas*")):
        lib = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(lib, name):
                getattr(lib, name)(1)
                break
