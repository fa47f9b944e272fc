"""Arrays of numbers as compact bytes, for rows that carry many numbers at once."""

from __future__ import annotations

import numpy as np


def zipped(x: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def unzipped(x: bytes, kind) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


def pack_sorted(x: np.ndarray) -> bytes:
    """Ascending unsigned numbers as their differences, like bytes side by side."""
    steps = np.diff(x, prepend=x.dtype.type(0))
    return zipped(steps.view(np.uint8).reshape(len(x), x.dtype.itemsize).T)


def unpack_sorted(x: bytes, kind) -> np.ndarray:
    planes = unzipped(x, np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(kind).ravel(), dtype=kind)


def edges(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins, and the end."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1], [True])))
