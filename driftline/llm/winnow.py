"""Anchored contexts: each window of a fixed length is owned by one of its k-grams, chosen by its content alone.

Equal windows, wherever they stand, have the same k-gram at the same place. So windows of one anchor hash need to be
compared with each other only, and windows that follow each other share an anchor and travel as one context.
"""

from __future__ import annotations

import numpy as np

#: Low bits that hold a position: enough for the longest text that a Spark row can hold.
_POSITION = np.uint64((1 << 31) - 1)
_BASE = 0x9E3779B97F4A7C15


class Grams:
    """Hashes of k-grams by prefix sums modulo 2^64, with powers kept from text to text."""

    def __init__(self) -> None:
        self.power = self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if n > len(self.power):
            n = max(n, 2 * len(self.power))
            self.power = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - 1, np.uint64(_BASE))])
            self.inverse = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - 1, np.uint64(pow(_BASE, -1, 1 << 64)))])

    def hashes(self, values: np.ndarray, k: int) -> np.ndarray:
        """One hash for each k consecutive values."""
        n = len(values)
        if n < k:
            return np.empty(0, np.uint64)
        self._grow(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(values * self.power[:n], out=total[1:])
        return mix64((total[k:] - total[:-k]) * self.inverse[: n - k + 1])


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit value."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def anchors(grams: np.ndarray, per_window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window) for windows of ``per_window`` k-grams: the leftmost least k-gram owns the window.

    The order is that of the hash's upper 33 bits, then of the position, which is the same for equal windows.
    """
    n = len(grams) - per_window + 1
    if n <= 0:
        none = np.empty(0, np.int64)
        return none, none, none
    m = (grams & ~_POSITION) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while 2 * width <= per_window:
        m = np.minimum(m[: len(m) - width], m[width:])
        width *= 2
    m = np.minimum(m[:n], m[per_window - width : per_window - width + n])
    at = (m & _POSITION).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return at[first], first, np.r_[first[1:], n] - 1
