"""Words of Arrow text columns as numpy arrays, a few megabytes at a time.

Whole batches are cut into words without a Python loop: word hashes are
differences of a running polynomial over the bytes, made position-free by the
inverse power and mixed. They are 64 bits wide, so that two of a billion
distinct words collide with a chance of about 3 in 100.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 21

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)

WHITESPACE = np.zeros(256, bool)
WHITESPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Everything but ASCII letters and digits and the bytes of other characters.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[0x41:0x5B] += 0x20


class _Powers:
    """Powers of the base and of its inverse, as many as were asked for so far.

    Functions travel to tasks with what they refer to. Tables that the driver
    filled, 34 MB of them, stay behind: a task makes its own.
    """

    def __init__(self) -> None:
        self.tables = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def __reduce__(self) -> tuple:
        return _Powers, ()


_powers = _Powers()


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.tables[0]) < n:
        size = max(n, SLICE_BYTES)
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers.tables[k] = np.cumprod(table, dtype=np.uint64)
    return _powers.tables[0], _powers.tables[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every input bit over all 64 (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words(NamedTuple):
    """Words in order: hash, row within the slice, and bytes [start, end)."""

    hash: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray


def utf8(texts: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A text column with null as the empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    return pc.fill_null(texts, "")


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the n + 1 offsets of their bounds."""
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, width, len(texts) + 1, texts.offset * width().itemsize)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], (offsets - offsets[0]).astype(np.int64)


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows with at most ``limit`` bytes, or one longer row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def edges(is_gap: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs without a gap that no row bound cuts."""
    n = len(is_gap)
    solid = ~is_gap
    first = solid.copy()
    first[1:] &= is_gap[:-1]
    inner = bounds[bounds < n]
    first[inner] |= solid[inner]
    last = solid.copy()
    last[:-1] &= is_gap[1:]
    inner = bounds[bounds > 0] - 1
    last[inner] |= solid[inner]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each byte range."""
    powers, inverse = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=total[1:])
    poly = (total[end] - total[start]) * inverse[start]
    return mix(poly + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words(
    data: np.ndarray,
    offsets: np.ndarray,
    gaps: np.ndarray = WHITESPACE,
    fold: np.ndarray | None = ASCII_LOWER,
) -> Words:
    """The words of a slice; ``offsets`` begins at the first byte of ``data``."""
    start, end = edges(gaps[data], offsets)
    row = np.searchsorted(offsets, start, side="right") - 1
    return Words(hashes(data if fold is None else fold[data], start, end), row, start, end)


def sliced_words(texts: pa.Array, limit: int = SLICE_BYTES, **how) -> Iterator[tuple[int, int, np.ndarray, Words]]:
    """First and last row, bytes and words of each slice of a text column."""
    data, offsets = buffers(texts)
    for lo, hi in slices(offsets, limit):
        part = data[offsets[lo] : offsets[hi]]
        yield lo, hi, part, words(part, offsets[lo : hi + 1] - offsets[lo], **how)


def per_row(row: np.ndarray, n_rows: int) -> np.ndarray:
    """Bounds of each row's items, given the ascending row of each item."""
    return np.searchsorted(row, np.arange(n_rows + 1))
