"""What a Python worker remembers between tasks: one operator's memo at a time.

Workers are reused, so the memos of several operators would add up. An operator
that starts work in a worker clears those of the others first.
"""

from __future__ import annotations

from collections.abc import Callable

_FORGET: dict[str, Callable[[], None]] = {}


def only(name: str, forget: Callable[[], None]) -> None:
    """Say that ``name`` works here now and how to clear its memo; other memos are cleared."""
    others = [k for k in _FORGET if k != name]
    for other in others:
        _FORGET.pop(other)()
    if others:
        release()
    _FORGET[name] = forget


def release() -> None:
    """Give memory that a finished task no longer uses back to the system; idle workers keep only their memo."""
    import ctypes
    import gc

    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)
