"""Word shingle sets of texts as 64-bit hashes, computed over whole batches."""

from __future__ import annotations

import numpy as np

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def _byte_values() -> np.ndarray:
    """A number per byte; capitals A-Z share that of their small letters, blanks have 0."""
    values = mix(_STEP * np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)
    values[65:91] = values[97:123]
    values[_BLANK] = 0
    return values


_VALUES = _byte_values()


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word (A-Z lower-cased) and the row it is in."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = ~_BLANK[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = ends[:-1][ends[:-1] < len(data)]
    first[edges] = inside[edges]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    spans = np.diff(np.append(starts, len(data)))
    powers = np.multiply.accumulate(np.full(int(spans.max()), _BASE, np.uint64))
    place = np.arange(starts[0], len(data)) - np.repeat(starts, spans)
    hashes = np.add.reduceat(_VALUES[data[starts[0]:]] * powers[place], starts - starts[0])
    return mix(hashes), np.searchsorted(ends, starts, "right") - 1


@np.errstate(over="ignore")
def shingle_sets(data: np.ndarray, ends: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each distinct shingle, sorted by both.

    A shingle is ``words`` consecutive words; a row with fewer has one, of all its words.
    """
    hashes, row = word_hashes(data, ends)
    n = len(hashes)
    per_row = np.bincount(row, minlength=len(ends) - 1) if n else np.zeros(len(ends) - 1, np.int64)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    factors = mix(_STEP * np.arange(101, 101 + words, dtype=np.uint64)) | np.uint64(1)
    short = np.flatnonzero((per_row > 0) & (per_row < words))
    begin = np.cumsum(per_row) - per_row
    few = [(hashes[begin[r]:begin[r] + per_row[r]] * factors[:per_row[r]]).sum() + np.uint64(per_row[r]) for r in short]
    rows, found = row[:0], hashes[:0]
    if n >= words:
        full = row[:n - words + 1] == row[words - 1:]
        total = np.zeros(n - words + 1, np.uint64)
        for k in range(words):
            total += hashes[k:n - words + 1 + k] * factors[k]
        rows, found = row[:n - words + 1][full], total[full]
    rows = np.concatenate([rows, short])
    found = mix(np.concatenate([found, np.array(few, np.uint64)]))
    order = np.lexsort((found, rows))
    rows, found = rows[order], found[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (found[1:] != found[:-1])
    return rows[new], found[new]
