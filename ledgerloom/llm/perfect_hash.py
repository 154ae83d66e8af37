"""Minimal perfect hashing of a set of 64-bit keys, with numpy.

Levels of bit fields: at each level the keys that are left are hashed into a field of twice their number,
and those that are alone at their place settle there. A key's number is the count of settled places before
its own, so n keys have the numbers 0 to n - 1. The keys are kept beside it by number, so a key that isn't
of the set is told apart.
"""

from __future__ import annotations

import numpy as np

from .textblocks import U64, mix

#: Places for each key of a level.
ROOM = 2
#: Levels after which two keys that are still together would be equal ones.
MOST_LEVELS = 200


class PerfectHash:
    """Numbers of the distinct int64 keys; -1 for any other key."""

    def __init__(self, keys: np.ndarray) -> None:
        left = np.unique(np.asarray(keys, np.int64))
        self.levels: list[tuple[int, int]] = []  # place at which each level's field begins, its size
        fields, begin = [], 0
        while len(left):
            if len(self.levels) == MOST_LEVELS:
                raise RuntimeError("keys that no level separates")
            size = ROOM * len(left)
            at = self._place(left, len(self.levels), size)
            field = np.bincount(at, minlength=size) == 1
            fields.append(field)
            self.levels.append((begin, size))
            begin += size
            left = left[~field[at]]
        field = np.concatenate(fields) if fields else np.zeros(0, bool)
        self.number = np.where(field, np.cumsum(field) - 1, -1).astype(np.int64)
        self.keys = np.zeros(int(field.sum()), np.int64)
        found = np.unique(np.asarray(keys, np.int64))
        self.keys[self._number(found)] = found

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys.astype(U64) + U64(((level + 1) * 0x9E3779B97F4A7C15) & (2**64 - 1))) % U64(size)).astype(np.int64)

    def _number(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, (begin, size) in enumerate(self.levels):
            if not len(open_):
                break
            got = self.number[begin + self._place(keys[open_], level, size)]
            out[open_] = got
            open_ = open_[got < 0]
        return out

    def __len__(self) -> int:
        return len(self.keys)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Number of each key, -1 where it isn't one of the set."""
        keys = np.asarray(keys, np.int64)
        got = self._number(keys)
        if len(self.keys):
            got[self.keys[got] != keys] = -1
        return got
