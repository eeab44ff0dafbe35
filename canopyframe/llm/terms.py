"""Terms (runs of digits, letters and characters beyond ASCII) as 64-bit hashes, over whole batches."""

from __future__ import annotations

import numpy as np

from canopyframe.llm.shingles import mix

_STEP = np.uint64(0x9E3779B97F4A7C15)
#: An odd number and its inverse modulo 2 ** 64.
_BASE = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
#: Bytes hashed at a time; a longer term is hashed as a whole.
PIECE = 1 << 20


def _byte_values() -> np.ndarray:
    """A number per byte of a term, A-Z as a-z; 0 for bytes between terms."""
    values = mix(_STEP * np.arange(401, 657, dtype=np.uint64)) | np.uint64(1)
    values[65:91] = values[97:123]
    values[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = 0
    return values


_VALUES = _byte_values()
_INSIDE = _VALUES != 0


def _powers(base: np.uint64, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(max(0, n - 1), base)]))


_UP, _DOWN = _powers(_BASE, PIECE), _powers(_INVERSE, PIECE)


def term_spans(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each term and the byte after it; terms end with their row."""
    inside = _INSIDE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = ends[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def term_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Hash of each term with A-Z as small letters; it depends on the term's bytes only."""
    out = np.empty(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        at = 0
        while at < len(starts):
            begin = starts[at]
            to = max(at + 1, int(np.searchsorted(stops, begin + PIECE, "right")))
            n = int(stops[to - 1] - begin)
            up, down = (_UP, _DOWN) if n <= PIECE else (_powers(_BASE, n), _powers(_INVERSE, n))
            local = starts[at:to] - begin
            sums = np.add.reduceat(_VALUES[data[begin:begin + n]] * up[:n], local)
            out[at:to] = mix(sums * down[local])
            at = to
    return out
