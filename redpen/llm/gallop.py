"""Galloping search: sorted needles in a longer sorted list, by exponential and then binary steps.

All needles move at once.  Every ``STRIDE``-th one starts where its rank would put it; the others
start from the place of the one before them and never leave the stretch between its and the next one's.
"""

from __future__ import annotations

import numpy as np

STRIDE = 32


def _search(needles: np.ndarray, hay: np.ndarray, start: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each needle the first place in ``low`` to ``high`` whose entry is not below it (``high`` if there is none)."""
    low, high = low.copy(), high.copy()
    inner = low < high
    start = np.where(inner, np.clip(start, low, np.maximum(high - 1, 0)), 0)
    below = inner & (hay[start] < needles)
    above = inner & ~below
    low[below] = start[below] + 1
    high[above] = start[above]
    for live, sign in ((np.flatnonzero(below), 1), (np.flatnonzero(above), -1)):
        step = 1
        while len(live):
            at = start[live] + sign * step
            live, at = (x[(at >= low[live]) & (at < high[live])] for x in (live, at))
            less = hay[at] < needles[live]
            low[live[less]] = at[less] + 1
            high[live[~less]] = at[~less]
            live = live[less] if sign > 0 else live[~less]
            step *= 2
    live = np.flatnonzero(low < high)
    while len(live):
        middle = (low[live] + high[live]) >> 1
        less = hay[middle] < needles[live]
        low[live[less]] = middle[less] + 1
        high[live[~less]] = middle[~less]
        live = live[low[live] < high[live]]
    return low


def places(needles: np.ndarray, hay: np.ndarray) -> np.ndarray:
    """For each of the ascending ``needles`` the number of entries of the ascending ``hay`` below it."""
    n, size = len(needles), len(hay)
    if not n or not size:
        return np.zeros(n, np.int64)
    firsts = needles[::STRIDE]
    rank = np.arange(len(firsts), dtype=np.int64) * STRIDE * size // n
    outer = _search(firsts, hay, rank, np.zeros(len(firsts), np.int64), np.full(len(firsts), size, np.int64))
    held = np.arange(n, dtype=np.int64) // STRIDE
    low, high = outer[held], np.append(outer[1:], size)[held]
    return _search(needles, hay, low + (np.arange(n) % STRIDE) * (high - low) // STRIDE, low, high)


def common(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places in ``a`` and in ``b`` (ascending, distinct) of what both hold; the shorter drives the search."""
    if len(a) > len(b):
        return common(b, a)[::-1]
    at = places(a, b)
    if not len(b):
        return at[:0], at[:0]
    same = b[np.minimum(at, len(b) - 1)] == a
    return np.flatnonzero(same), at[same]
