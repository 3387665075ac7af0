"""Sets of hashed word shingles, computed for whole slices of texts at once."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from stellwerk.llm.batches import lower_ascii, mix

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _FACTOR)


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd factor and of its inverse, modulo 2**64."""
    factor, inverse = np.uint64(0xD6E8FEB86659FD93), np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
    power, back = np.full(size, factor), np.full(size, inverse)
    power[0] = back[0] = 1
    return np.cumprod(power, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)


def words(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, 64-bit hash) of every word, A-Z lower-cased; words end at ASCII white space and with their row."""
    size = len(data)
    if not size:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    low = lower_ascii(data)
    inside = ~_SPACE[low]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    first = offsets[:-1][offsets[:-1] < size]
    begins[first] = inside[first]
    last = offsets[1:][offsets[1:] > 0] - 1
    ends[last] = inside[last]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    power, back = _powers(1 << max(int(size - 1).bit_length(), 16))
    total = np.zeros(size + 1, np.uint64)
    np.cumsum(_BYTE[low] * power[:size], out=total[1:])
    code = (total[stops] - total[starts]) * back[starts]
    row = np.searchsorted(offsets, starts, "right") - 1
    return row, mix(code + (stops - starts).astype(np.uint64) * _FACTOR)


def shingle_sets(offsets: np.ndarray, data: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(set ends, hashes): each row's distinct shingles of ``size`` words, sorted, one row after the other.

    A row with fewer words has one shingle, all its words; a row without words has none.
    """
    n = len(offsets) - 1
    row, word = words(offsets, data)
    per_row = np.bincount(row, minlength=n)
    first = np.cumsum(per_row) - per_row
    count = np.where(per_row >= size, per_row - size + 1, np.minimum(per_row, 1))
    ends = np.concatenate(([0], np.cumsum(count)))
    shingles = np.empty(ends[-1], np.uint64)
    long = per_row >= size
    if long.any():
        rows = np.flatnonzero(long)
        at = np.repeat(first[rows] - (np.cumsum(count[rows]) - count[rows]), count[rows]) + np.arange(count[rows].sum())
        code = np.full(len(at), np.uint64(size))
        for i in range(size):
            code = mix(code * _FACTOR + word[at + i])
        shingles[np.repeat(long, count)] = code
    for length in range(1, size):
        rows = np.flatnonzero(per_row == length)
        if len(rows):
            code = np.full(len(rows), np.uint64(length))
            for i in range(length):
                code = mix(code * _FACTOR + word[first[rows] + i])
            shingles[ends[rows]] = code
    sets = [np.unique(shingles[a:b]) for a, b in zip(ends[:-1], ends[1:])]
    return np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int64), np.concatenate([*sets, np.empty(0, np.uint64)])
