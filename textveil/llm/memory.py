"""What a Python worker keeps between calls: one thing at a time.

Workers outlive tasks and stages, so what one operator leaves there would lie beside
the next one's data.  Whatever is asked for replaces all else.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable

import pyarrow as pa

_held: dict[Hashable, object] = {}


def held(key: Hashable, make: Callable[[], object]):
    """What ``make`` gave when ``key`` was first asked for, if nothing else has been since."""
    if key not in _held:
        released()
        _held[key] = make()
    return _held[key]


def released() -> None:
    """Forget what is held and give free memory back to the system.

    Operators that keep nothing begin with this, and those whose tasks hold much end
    with it: what the allocators would keep lies beside the next operator's data.
    """
    _held.clear()
    gc.collect()
    trimmed()


def forgotten() -> None:
    """Forget what is held, if anything is; cheap enough for each batch."""
    if _held:
        released()


def trimmed() -> None:
    """Give free memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass
