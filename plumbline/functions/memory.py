"""Memory of Python workers."""

from __future__ import annotations

import ctypes

import pyarrow as pa


def give_back() -> None:
    """Hands memory that a task has freed back to the system: workers stay, and wait beside those of later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
