"""Two-dimensional range reporting: points on a grid, one a column, asked for by rectangles."""

from __future__ import annotations

import numpy as np


class WaveletTree:
    """The points (i, values[i]) for a permutation ``values`` of 0..n-1.

    Level by level, from the highest bit of a value down, every node's points are
    split by that bit with their order kept; a level stores, for each place, how
    many points before it go left.  A rectangle descends only where it still has
    columns and where the node's values meet it, so it costs a path a point that
    it reports, and two paths for its ends.
    """

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        self.bits = max(1, int(self.n - 1).bit_length())
        self.left = []
        at = values.astype(np.int64)
        for level in range(self.bits):
            goes_left = at >> (self.bits - 1 - level) & 1 == 0
            self.left.append(np.concatenate([[0], np.cumsum(goes_left)]))
            # By node, left before right, order kept: nodes are told by the bits from here up.
            at = at[np.argsort(at >> (self.bits - 1 - level), kind="stable")]

    def report(self, low: np.ndarray, high: np.ndarray, bottom: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rectangle, value) of every point with low <= column < high and bottom <= value < top."""
        which = np.arange(len(low))
        node, first = np.zeros(len(low), np.int64), np.zeros(len(low), np.int64)  # values begin with node's bits; first: where it starts
        low, high = low.astype(np.int64), high.astype(np.int64)  # places within the level
        for level in range(self.bits):
            shift, left = self.bits - 1 - level, self.left[level]
            end = np.minimum(self.n, (node + 1) << (shift + 1))  # a permutation: a node holds as many points as values
            before, all_left = left[first], left[end] - left[first]
            l0, h0 = first + left[low] - before, first + left[high] - before
            l1, h1 = first + all_left + (low - first) - (left[low] - before), first + all_left + (high - first) - (left[high] - before)
            kept = []
            for bit, l, h, start in ((0, l0, h0, first), (1, l1, h1, first + all_left)):
                child = node << 1 | bit
                meets = (l < h) & (child << shift < top[which]) & ((child + 1) << shift > bottom[which])
                kept.append([x[meets] for x in (which, child, start, l, h)])
            which, node, first, low, high = (np.concatenate(x) for x in zip(*kept, strict=True))
        return which, node
