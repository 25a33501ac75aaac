"""Texts of an Arrow batch as one array of UTF-8 bytes, and their words as arrays.

All functions work on a slice of a batch at a time (`slices`), so memory follows
the slice, or one text where that is longer, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 21
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Of a lower-cased text: digits, a-z and whatever is not ASCII.
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True
BYTE_CODES = np.random.default_rng(20240501).integers(0, 1 << 64, 256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and their n + 1 offsets; a null is an empty text."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def slices(data: np.ndarray, offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of texts of about `limit` bytes."""
    first, n = 0, len(offsets) - 1
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def powers(n: int, of: str = "base") -> np.ndarray:
    """The first n powers of BASE, or of its inverse, modulo 2**64."""
    have = _powers.get(of)
    if have is None or len(have) < n:
        factors = np.full(max(n, SLICE_BYTES + 1), BASE if of == "base" else INVERSE, np.uint64)
        factors[0] = 1
        _powers[of] = have = np.cumprod(factors)
        if n > 4 * SLICE_BYTES:  # for one very long text only
            _powers.pop(of)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums of code * BASE**position before each position: a range's hash is a difference times a power."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODES[data] * powers(len(data)), out=sums[1:])
    return sums


def range_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    inverse = powers(len(sums), "inverse")
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, starts and ends of words, and each text's first word (n + 1)."""
    low = LOWER[data]
    flag = IS_WORD[low]
    before, after = np.zeros_like(flag), np.zeros_like(flag)
    if len(flag):
        before[1:], after[:-1] = flag[:-1], flag[1:]
        inner = offsets[1:-1]
        before[inner[inner < len(flag)]] = False
        after[inner[inner > 0] - 1] = False
    starts = np.flatnonzero(flag & ~before)
    ends = np.flatnonzero(flag & ~after) + 1
    return low, starts, ends, np.searchsorted(starts, offsets)


def word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return range_hashes(prefix_sums(low), starts, ends)


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` words, also of those that cross texts."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out *= BASE
        out += hashes[k : k + n]
    return mix(out)


def windows_inside(first_words: np.ndarray, size: int, n: int) -> np.ndarray:
    """Of the n windows of `size` words, those that lie within one text."""
    whole = np.ones(n, bool)
    for back in range(1, size):
        at = first_words[1:-1] - back
        whole[at[(at >= 0) & (at < n)]] = False
    return whole
