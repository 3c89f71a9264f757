"""Vectorised scanning of the texts of an Arrow batch: bytes, words and their 64-bit hashes.

Words are the runs of bytes other than ASCII white space, after lower-casing A-Z. A hash is a polynomial in random
64-bit values of the bytes, modulo 2**64, then mixed; two different words share one with a probability near 2**-56.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 21
_P = np.uint64(0x9E3779B97F4A7C13)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C13, -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUES = np.random.Generator(np.random.PCG64(20240611)).integers(0, 1 << 64, 256, dtype=np.uint64)[_LOWER]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class _Powers:
    up = np.ones(1, dtype=np.uint64)
    down = np.ones(1, dtype=np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, CHUNK_BYTES + 1)
            cls.up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, _P)]))
            cls.down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, _P_INV)]))
        return cls.up, cls.down


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its offsets, one more than rows; a null is empty."""
    column = column.cast(pa.large_utf8()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about size bytes each; a longer row is alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word in order, number of words of every row)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    inside = ~_SPACE[data]
    begins = np.zeros(n + 1, dtype=bool)
    begins[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | begins[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | begins[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _Powers.upto(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_VALUES[data] * up[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts])
    at = np.searchsorted(starts, offsets)
    return hashes, np.diff(at)


def has_any(data: np.ndarray, offsets: np.ndarray, of: bytes) -> np.ndarray:
    """Which rows hold at least one of the given bytes."""
    table = np.zeros(256, dtype=bool)
    table[list(of)] = True
    where = np.flatnonzero(table[data])
    at = np.searchsorted(where, offsets)
    return at[1:] > at[:-1]
