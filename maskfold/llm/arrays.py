"""Words of many texts at once, as NumPy arrays over the UTF-8 bytes of an Arrow column.

Used inside Spark tasks only. Work goes in pieces of a few megabytes, so memory does not depend on the
size of an Arrow batch or a group, only on its longest text.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C55  # odd, so it has an inverse modulo 2**64

IS_GAP = np.zeros(256, bool)
IS_GAP[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@dataclass
class Piece:
    """Rows first .. first+rows of a column: their bytes, byte offsets, and words (row, start, end, hash)."""

    first: int
    rows: int
    data: np.ndarray
    offsets: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    bounds: np.ndarray  # words of row i are bounds[i]:bounds[i + 1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64); wraps around."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def cumulate(base: int) -> np.ndarray:
        p = np.full(n + 1, base, np.uint64)
        p[0] = 1
        return np.cumprod(p)

    return cumulate(_BASE), cumulate(pow(_BASE, -1, 1 << 64))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end], from prefix sums of a polynomial in the bytes."""
    size = PIECE
    while size < len(data):
        size *= 2
    up, down = _powers(size)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def column_bytes(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and its row offsets; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):  # more than one chunk is left
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.large_string())
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    all_bytes = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return all_bytes, at


def pieces(texts: pa.Array | pa.ChunkedArray, lower: bool = False) -> Iterator[Piece]:
    """The column in pieces of about PIECE bytes, at least one row each, with their words."""
    data, at = column_bytes(texts)
    first = 0
    while first < len(at) - 1:
        last = max(first + 1, int(np.searchsorted(at, at[first] + PIECE, "right")) - 1)
        by, off = data[at[first] : at[last]], at[first : last + 1] - at[first]
        if lower:
            by = LOWER[by]
        word = ~IS_GAP[by]
        lead, tail = word.copy(), word.copy()
        lead[1:] &= ~word[:-1]
        tail[:-1] &= ~word[1:]
        filled = off[:-1] < off[1:]
        heads, ends = off[:-1][filled], off[1:][filled] - 1
        lead[heads], tail[ends] = word[heads], word[ends]
        start, end = np.flatnonzero(lead), np.flatnonzero(tail) + 1
        bounds = np.searchsorted(start, off)
        row = np.repeat(np.arange(last - first), np.diff(bounds))
        yield Piece(first, last - first, by, off, row, start, end, span_hashes(by, start, end), bounds)
        first = last
