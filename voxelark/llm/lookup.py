"""A fixed table from 64-bit numbers to places, looked up in whole arrays."""

from __future__ import annotations

import numpy as np

_U = np.uint64


class Lookup:
    """Place of each of ``keys`` (distinct), by linear probing."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys = keys.astype(np.uint64)
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.mask = _U((1 << bits) - 1)
        self.slot = np.full(1 << bits, -1, dtype=np.int32)
        left, at = np.arange(len(keys)), (keys & self.mask).astype(np.int64)
        while len(left):
            free = np.flatnonzero(self.slot[at] < 0)
            got, first = np.unique(at[free], return_index=True)
            self.slot[got] = left[free[first]]
            stay = np.ones(len(left), dtype=bool)
            stay[free[first]] = False
            left, at = left[stay], (at[stay] + 1) & int(self.mask)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Places of ``x``; -1 for numbers that aren't there."""
        out = np.full(len(x), -1, dtype=np.int64)
        if not len(self.keys):
            return out
        left, at = np.arange(len(x)), (x & self.mask).astype(np.int64)
        while len(left):
            s = self.slot[at]
            full = s >= 0
            left, at, s = left[full], at[full], s[full]
            hit = self.keys[s] == x[left]
            out[left[hit]] = s[hit]
            left, at = left[~hit], (at[~hit] + 1) & int(self.mask)
        return out
