"""Words, word hashes and shingles of Arrow text columns, in numpy, a bounded block of bytes at a time.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a null text has none. Hashes have 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (shift and multiply rounds)."""
    x = x + _GOLD
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(_LOWER.astype(np.uint64) + np.uint64(1000))
_BASE = np.uint64(0x2545F4914F6CDD1D)


def powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWERS = powers(64)


def text_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the len + 1 offsets in them; nulls are empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of rows of at most ``limit`` bytes, or of one longer row."""
    data, offsets = text_arrays(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, to, data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at]
        at = to


def word_bounds(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of all words of a block, and for each row the number of words before it (len + 1); words end at bytes of ``gap``."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    inside = ~gap[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1]))
    after = np.concatenate((inside[1:], [False]))
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = _BYTE) -> np.ndarray:
    """One 64-bit hash for each word, in runs of words that stay small in memory."""
    out = np.zeros(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + BLOCK, side="right")))
        s, size = starts[at:to], (ends - starts)[at:to]
        first = np.cumsum(size) - size
        place = np.arange(int(size.sum())) - np.repeat(first, size)
        scale = _POWERS if size.max() <= len(_POWERS) else powers(int(size.max()))
        out[at:to] = np.add.reduceat(table[data[np.repeat(s, size) + place]] * scale[place], first)
        at = to
    return mix(out)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a block and the number of words before each row (len + 1)."""
    starts, ends, rows = word_bounds(data, offsets)
    return hashes_of(data, starts, ends), rows


def shingles(hashes: np.ndarray, rows: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles and the number before each row; fewer words make one shingle, none make none."""
    n = np.diff(rows)
    counts = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    ends = np.cumsum(counts)
    at = np.arange(int(counts.sum())) - np.repeat(ends - counts, counts) + np.repeat(rows[:-1], counts)
    last = np.repeat(rows[1:], counts)
    total = np.zeros(len(at), np.uint64)
    padded = np.concatenate((hashes, np.zeros(1, np.uint64)))
    for j in range(k):
        total = mix(total ^ padded[np.where(at + j < last, at + j, len(hashes))])
    return total, np.concatenate(([0], ends))


def distinct_by_row(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values of each row and the number before each row."""
    n = len(rows) - 1
    owner = np.repeat(np.arange(n), np.diff(rows))
    order = np.argsort(values)
    order = order[np.argsort(owner[order].astype(np.uint16 if n <= 1 << 16 else np.int64), kind="stable")]  # 16 bits are sorted by counting
    values, owner = values[order], owner[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[fresh], np.concatenate(([0], np.cumsum(np.bincount(owner[fresh], minlength=n))))
