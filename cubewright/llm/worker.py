"""What a Python worker keeps from task to task: one thing at a time, given up as soon as another operator runs there."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable
from typing import Any

import pyarrow as pa

_held: dict[Hashable, Any] = {}


def kept(key: Hashable, build: Callable[[], Any]) -> Any:
    """The object of this key, built unless this worker has it; that of any other key goes first."""
    if key not in _held:
        release()
        _held[key] = build()
    return _held[key]


def release(but: Hashable = None) -> None:
    """Give up what is kept under another key than ``but``."""
    others = [k for k in _held if k != but]
    for k in others:
        del _held[k]
    if others:
        give_back()


def give_back() -> None:
    """Return freed memory to the machine; allocators keep it for themselves otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
