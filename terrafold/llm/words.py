"""Words and n-grams of a batch of texts as 64-bit hashes, computed over the bytes of an Arrow column at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
#: Everything in ASCII that is neither letter nor digit; bytes of other characters count as letters.
PUNCTUATION = np.array([x < 128 and not chr(x).isalnum() for x in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUE = np.random.Generator(np.random.PCG64(20)).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_VALUE = _VALUE[_LOWER]  # upper case counts as lower case
_BASE = 0x9E3779B97F4A7C15
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(x: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number modulo 2**64, and of its inverse."""
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def parts(column: pa.Array, most_bytes: int = 1 << 17) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, bytes, and bounds (rows + 1) of consecutive rows of a string column, a bounded number of bytes at a
    time (one row at least), so that the arrays of a step stay in the processor's cache. Null is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most_bytes, "right")) - 1)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def words(data: np.ndarray, bounds: np.ndarray, between: np.ndarray = _BLANK) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (A-Z as a-z), and the bounds of each text's words. ``between``: the bytes that part words."""
    n = len(data)
    if not n:
        return np.empty(0, np.uint64), np.zeros(len(bounds), np.int64)
    inside = ~between[data]
    first = np.zeros(n + 1, bool)
    first[bounds] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | first[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    power, inverse = powers(n + 1)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_VALUE[data] * power[:n], out=sums[1:])
    hashes = mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, bounds)


def shingles(hashes: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``size`` words within a text, and the bounds of each text's runs.

    A text of fewer words has its whole sequence as one; a text without words has none.
    """
    n_words = np.diff(bounds)
    counts = np.where(n_words >= size, n_words - size + 1, np.minimum(n_words, 1))
    to = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(to[-1], np.uint64)
    long = n_words >= size
    if long.any():
        rolled = np.zeros(max(0, len(hashes) - size + 1), np.uint64)
        for k in range(size):
            rolled = mixed(rolled * np.uint64(_BASE) + hashes[k : len(hashes) - size + 1 + k]) if k == size - 1 else rolled * np.uint64(_BASE) + hashes[k : len(hashes) - size + 1 + k]
        own = np.repeat(long, counts)
        at = np.arange(to[-1]) - np.repeat(to[:-1] - bounds[:-1], counts)
        out[own] = rolled[at[own]]
    for i in np.flatnonzero(~long & (n_words > 0)):
        h = 0
        for w in hashes[bounds[i] : bounds[i + 1]].tolist():
            h = (h * _BASE + w) % (1 << 64)
        out[to[i]] = mixed(np.array([h + int(n_words[i])], np.uint64))[0]
    return out, to
