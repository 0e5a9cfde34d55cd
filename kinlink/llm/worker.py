"""What a Python worker of an executor keeps between tasks. Workers live on from stage to stage, so what one stage leaves is held while the next runs."""

from __future__ import annotations

import ctypes
import time
from collections.abc import Callable

import pyarrow as pa

_kept: dict = {}
_state = {"set": False, "trimmed": 0.0}
#: mallopt() of glibc. Without it, freed arrays raise the size from which memory is mapped by itself, up to 32 MB, and stay in the heap.
_TRIM_THRESHOLD, _MMAP_THRESHOLD, _LARGE = -1, -3, 1 << 20


def kept(name: tuple, make: Callable):
    """What the tasks of one kind share, made once for each worker; it goes when the worker takes up tasks of another kind."""
    if name not in _kept:
        lean()
        _kept[name] = make()
    return _kept[name]


def lean(own: tuple | None = None) -> None:
    """At the head of a task's function: lets go what tasks of another kind kept, and gives free memory back to the system, at most once a second."""
    for name in [k for k in _kept if k != own]:
        del _kept[name]
    if time.monotonic() - _state["trimmed"] < 1:
        return
    _state["trimmed"] = time.monotonic()
    pa.default_memory_pool().release_unused()
    try:
        libc = ctypes.CDLL(None)
        if not _state["set"]:
            libc.mallopt(_MMAP_THRESHOLD, _LARGE)
            libc.mallopt(_TRIM_THRESHOLD, _LARGE)
            _state["set"] = True
        libc.malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
