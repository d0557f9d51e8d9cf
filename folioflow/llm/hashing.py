"""Vectorised window hashes over bytes and words (numpy, inside tasks).

They are polynomials modulo 2**64 and can be made to collide, so they choose candidates only; what is equal is
decided by digests or by bytes.
"""

from __future__ import annotations

import numpy as np

#: An odd multiplier of a polynomial hash modulo 2**64, and its inverse.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Most bytes whose powers are kept; longer inputs are hashed in segments.
SEGMENT = 1 << 20

#: Random values of the bytes.
_VALUES = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 64, 256, dtype=np.uint64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(12, int(n).bit_length())
    if size not in _powers:
        with np.errstate(over="ignore"):
            both = []
            for base in (_BASE, _INVERSE):
                p = np.full(size, base, np.uint64)
                p[0] = 1
                both.append(np.multiply.accumulate(p))
        if size > 4 * SEGMENT:  # of a very long word: not worth keeping
            return both[0], both[1]
        _powers[size] = (both[0], both[1])
    return _powers[size]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] = sum of value(data[t]) * BASE**t over i <= t < j, modulo 2**64."""
    values = _VALUES[data]
    values *= _power_tables(len(data))[0][: len(data)]
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values, out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Hashes of the spans, alike for equal contents wherever they stand."""
    h = sums[stops] - sums[starts]
    h *= _power_tables(len(sums))[1][starts]
    return mix(h)


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the runs of bytes other than the six blanks."""
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.diff(np.concatenate([[False], solid, [False]]).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_window_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, width: int) -> np.ndarray:
    """A hash of every window of ``width`` words; words are parted by one blank byte each."""
    n = len(starts) - width + 1
    parts: list[np.ndarray] = []
    at = 0
    while at < n:
        # as many windows as end within a segment, one at least
        end = min(n, max(at + 1, int(np.searchsorted(stops, starts[at] + SEGMENT)) - width + 1))
        a, b = starts[at], stops[end + width - 2]
        parts.append(span_hashes(prefix_sums(data[a:b]), starts[at:end] - a, stops[at + width - 1 : end + width - 1] - a))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)
