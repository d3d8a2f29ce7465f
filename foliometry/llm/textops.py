"""Whole batches of texts as byte arrays: words, hashes and shingles without a Python loop per word.

An Arrow string column already is one buffer of UTF-8 bytes with offsets; the
functions here work on such a buffer. Texts are taken in slices of a few
megabytes, so the arrays of eight bytes a character stay small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240229)
#: Random odd multiplier and one random number for each byte value: the rolling hash.
_BASE = np.uint64(int(_RNG.integers(1 << 61, 1 << 62)) * 4 + 3)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SLICE = 1 << 20
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for name, base in (("up", _BASE), ("down", inverse)):
            out = np.full(max(n, SLICE), base, np.uint64)
            out[0] = 1
            _POWERS[name] = np.multiply.accumulate(out)
    return _POWERS["up"], _POWERS["down"]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(data: np.ndarray, offsets: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of pieces of about ``most`` bytes; a text is never cut."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z; other bytes stay."""
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


#: Bytes that words consist of: all but space and line ends; or letters, digits and what is not ASCII.
SOLID = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])
LETTERS = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def words(data: np.ndarray, offsets: np.ndarray, of: np.ndarray = SOLID) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of bytes in ``of`` within a row."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = of[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def prefix(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums: ``span_hash`` reads any span's hash from two of them."""
    up, _ = _powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans: equal bytes give equal hashes wherever they stand."""
    _, down = _powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def shingles(hashes: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of every ``n`` successive words of one row."""
    k = len(hashes) - n + 1
    if k <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(k, np.uint64)
    for j in range(n):
        out += hashes[j : j + k] * _STEP[j]
    at = np.flatnonzero(row[:k] == row[n - 1 :])
    return mix(out[at]), at


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, values): row i has the sorted distinct ``values[bounds[i]:bounds[i + 1]]``.

    A row with fewer than ``n`` words, but one at least, has its whole sequence as one shingle.
    """
    rows = len(offsets) - 1
    low = lowered(data)
    start, end, row = words(low, offsets)
    h = span_hash(prefix(low), start, end)
    value, at = shingles(h, row, n)
    owner = row[at]
    count = np.bincount(row, minlength=rows)
    few = np.flatnonzero((count > 0) & (count < n))
    if len(few):
        begin = np.searchsorted(row, few)
        extra = np.zeros(len(few), np.uint64)
        for j in range(n - 1):
            has = count[few] > j
            extra[has] += h[begin[has] + j] * _STEP[j]
        value = np.concatenate([value, mix(extra + count[few].astype(np.uint64) * _STEP[n])])
        owner = np.concatenate([owner, few])
    order = np.argsort(value)  # equal ones in any order, as one of them stays
    order = order[np.argsort(owner[order].astype(np.uint16 if rows <= 1 << 16 else np.int64), kind="stable")]
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[new], owner[new]
    return np.searchsorted(owner, np.arange(rows + 1)), value
