"""Vectorised hashing of the words, bytes and characters of Arrow string batches.

Works on the UTF-8 buffer of a batch in pieces of about PIECE bytes, so memory
is bounded by a piece, or by the longest text where one is longer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd: it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1 of the base and of its inverse, kept by the worker."""
    if len(_powers[0]) < n:
        size = max(n, PIECE + 4096)
        for k, b in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pieces(text: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) for runs of rows; null is empty."""
    text = text.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, text.offset * 8)
    data = text.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(text):
        end = int(np.searchsorted(offsets, offsets[row] + PIECE, side="right")) - 1
        end = min(max(end, row + 1), len(text))
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def rolling(data: np.ndarray) -> np.ndarray:
    """Prefix sums for ``window_hash``; entry i covers the first i bytes."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(len(data) + 1)[0][: len(data)], out=out[1:])
    return out


def window_hash(sums: np.ndarray, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
    """Hash of bytes [start, end), the same wherever the bytes stand."""
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start])


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True, separators: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, of): the words of a piece in order; of has each row's first word, and the count at its end."""
    inside = ~separators[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] |= inside[edges]
    last[edges - 1] |= inside[edges - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = rolling(_LOWER[data] if lower else data)
    return window_hash(sums, start, end), start, end, np.searchsorted(start, offsets)


def combined(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k hashes in a row (across rows of the piece too)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9FB21C651E98DF25) + hashes[j : j + n]
    return mix(out)


def shingle_sets(text: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its k-word shingles; fewer words make one shingle, no word none."""
    for _, data, offsets in pieces(text):
        hashes, _, _, of = words(data, offsets)
        grams = combined(hashes, k)
        for a, b in zip(of[:-1].tolist(), of[1:].tolist(), strict=True):
            if b - a >= k:
                yield np.unique(grams[a : b - k + 1])
            elif b > a:
                yield combined(hashes[a:b], b - a) ^ np.uint64(b - a)
            else:
                yield np.zeros(0, np.uint64)
