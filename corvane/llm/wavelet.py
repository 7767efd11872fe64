"""A wavelet matrix over a permutation, for reporting the points of many rectangles at once."""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Values at places 0 to n - 1; report() finds, for ranges of places and of values, which values stand there.

    Each level keeps one bit of every value, the highest first, and how many zeros stand before each place. Values whose
    bit is zero go to the front of the next level, so a range of places becomes two ranges there, one for each bit.
    """

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        self.bits = max(1, int(self.n - 1).bit_length()) if self.n else 0
        self.zeros: list[np.ndarray] = []
        left = np.asarray(values, np.int64)
        for bit in range(self.bits - 1, -1, -1):
            one = (left >> bit) & 1
            self.zeros.append(np.concatenate([[0], np.cumsum(1 - one)]).astype(np.int32))
            left = np.concatenate([left[one == 0], left[one == 1]])

    def report(self, first: np.ndarray, last: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rectangle, value) of every value from low to high - 1 at places first to last - 1, for all rectangles side by side."""
        which = np.flatnonzero((first < last) & (low < high))
        a, b = first[which].astype(np.int64), last[which].astype(np.int64)
        base = np.zeros(len(which), np.int64)
        for level, zeros in enumerate(self.zeros):
            width = 1 << (self.bits - 1 - level)
            za, zb, none = zeros[a].astype(np.int64), zeros[b].astype(np.int64), int(zeros[-1])
            parts = ((which, za, zb, base), (which, none + a - za, none + b - zb, base + width))
            # A range goes on where it holds a place and its values can lie in the rectangle.
            kept = [(y > x) & (v < high[w]) & (v + width > low[w]) for w, x, y, v in parts]
            which, a, b, base = (np.concatenate([p[i][k] for p, k in zip(parts, kept)]) for i in range(4))
        return which, base
