"""Order statistics of many windows at once, in numpy, for the tasks of rolling medians.

Rows stand in order of time, a window is a run of them. Their value ranks are sorted by one bit after the other,
the highest first; counts of the rows that have a 0 there tell for all windows at once in which half the wanted place
lies. So n rows and q questions take (n + q) log n steps, whatever the windows' lengths.
"""

from __future__ import annotations

import numpy as np


def kth_in_windows(value: np.ndarray, weight: np.ndarray, begin: np.ndarray, end: np.ndarray, place: np.ndarray) -> np.ndarray:
    """For each question the value at `place` (from 0, by value) among rows begin to end - 1, each counted weight times.

    A place has to be below the window's total weight."""
    if not len(place):
        return np.zeros(0)
    levels, rank = np.unique(value, return_inverse=True)
    lo, hi, k = begin.astype(np.int64), end.astype(np.int64), place.astype(np.int64)
    found = np.zeros(len(k), np.int64)
    w = weight.astype(np.int64)
    for bit in reversed(range(max(1, int(len(levels) - 1).bit_length()))):
        zero = (rank >> bit) & 1 == 0
        count = np.append(0, np.cumsum(zero))
        weighed = np.append(0, np.cumsum(np.where(zero, w, 0)))
        low = weighed[hi] - weighed[lo]
        up = k >= low
        k = np.where(up, k - low, k)
        found |= up.astype(np.int64) << bit
        lo, hi = np.where(up, count[-1] + lo - count[lo], count[lo]), np.where(up, count[-1] + hi - count[hi], count[hi])
        order = np.concatenate([np.flatnonzero(zero), np.flatnonzero(~zero)])
        rank, w = rank[order], w[order]
    return levels[found]


def medians_of_windows(value: np.ndarray, begin: np.ndarray, end: np.ndarray, least: int = 1) -> np.ndarray:
    """Median of rows begin to end - 1 for each window; nan values don't count, and fewer than least give nan."""
    there = ~np.isnan(value)
    upto = np.append(0, np.cumsum(there))
    n = upto[end] - upto[begin]
    ok = n >= max(1, least)
    out = np.full(len(begin), np.nan)
    b, e, m = upto[begin[ok]], upto[end[ok]], n[ok]
    kept = value[there]
    ones = np.ones(len(kept), np.int64)
    low, high = kth_in_windows(kept, ones, b, e, (m - 1) // 2), kth_in_windows(kept, ones, b, e, m // 2)
    out[ok] = np.where(m % 2 == 1, low, (low + high) / 2)
    return out


def sliding_medians(day: np.ndarray, value: np.ndarray, frames: list[tuple[int, str, int]], ties: str = "peers") -> list[np.ndarray]:
    """Medians for each (days, closed, min_n) over rows in order of day; closed is "left" or "right".

    ties "row": a right-closed window ends at the row, "peers": at the last row of its day.
    """
    out = []
    for days, closed, least in frames:
        if closed == "left":
            begin, end = np.searchsorted(day, day - days, "left"), np.searchsorted(day, day, "left")
        else:
            begin = np.searchsorted(day, day - days + 1, "left")
            end = np.arange(1, len(day) + 1) if ties == "row" else np.searchsorted(day, day, "right")
        out.append(medians_of_windows(value, begin, end, least))
    return out
