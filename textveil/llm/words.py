"""Words of Arrow text columns as numpy arrays, without a Python object per word.

A word is a run of bytes other than space and tab to carriage return, so words
can be cut in the UTF-8 bytes themselves.  Each gets a 64-bit hash: a polynomial
of its bytes from prefix sums (powers of an odd number modulo 2**64), scrambled.
Work goes in short stretches of bytes that stay in the processor's cache.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
ODD = U(0x9E3779B97F4A7C15)
STRETCH = 1 << 18
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two hashes in order."""
    return scramble(a * ODD + b)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers of the base and of its inverse."""
    if len(_powers[0]) < n:
        size = max(STRETCH * 2, 1 << (n - 1).bit_length())
        for k, base in enumerate((int(ODD), pow(int(ODD), -1, 1 << 64))):
            row = np.full(size, base, U)
            row[0] = 1
            _powers[k] = np.multiply.accumulate(row)
    return _powers[0], _powers[1]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte spans given in ascending order without overlap."""
    out = np.empty(len(start), U)
    i = 0
    while i < len(start):
        base = start[i]
        j = max(i + 1, int(np.searchsorted(end, base + STRETCH, "right")))
        stretch = data[base : end[j - 1]]
        up, down = powers(len(stretch) + 1)
        sums = np.zeros(len(stretch) + 1, U)
        np.cumsum((stretch.astype(U) + U(1)) * up[: len(stretch)], out=sums[1:])
        s, e = start[i:j] - base, end[i:j] - base
        out[i:j] = scramble((sums[e] - sums[s]) * down[s] + (e - s).astype(U))
        i = j
    return out


class Words(NamedTuple):
    data: np.ndarray  # bytes of all texts, A-Z in lower case if asked for
    offsets: np.ndarray  # where each text begins, and the end
    start: np.ndarray  # of each word in data
    end: np.ndarray
    first: np.ndarray  # number of the first word of each text, and the end


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and where each text begins; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def cut_words(texts: pa.Array, lower: bool = True, separator: np.ndarray = SEPARATOR) -> Words:
    """Where the words of each text are; ``separator`` tells for each byte if it ends a word."""
    data, offsets = raw_bytes(texts)
    if lower:
        data = LOWER[data]
    inside = ~separator[data]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[edge] = inside[edge]
    ends[:-1] &= ~inside[1:]
    ends[edge - 1] = inside[edge - 1]
    start = np.flatnonzero(begins)
    return Words(data, offsets, start, np.flatnonzero(ends) + 1, np.searchsorted(start, offsets))


def text_of(first: np.ndarray) -> np.ndarray:
    """For each word, the number of its text."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``most`` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = raw_bytes(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
            to = min(batch.num_rows, max(at + 1, to))
            yield batch.slice(at, to - at)
            at = to


def sorted_counts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and how often each occurs."""
    keys = np.sort(keys)
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[at], np.diff(np.append(at, len(keys)))
