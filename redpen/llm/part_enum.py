"""PartEnum signatures: sets that are similar enough share at least one of them.

Sets are put into bands by size.  Inside the pairs of a band the Jaccard bound becomes a bound
k on the size of the symmetric difference.  The features are hashed into ``first`` parts, each cut
into ``second`` smaller ones; with ``first * (skip + 1) > k`` two such sets differ in at most ``skip`` of
the smaller parts of some part, so they agree on one of the subsets that leave ``skip`` out.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np

from redpen.llm.wordhash import mix


@dataclass(frozen=True)
class Plan:
    """``spare``: how many parts more than needed there are.  With at most that many parts of one
    element or none, a set can leave those out: one of its fuller parts still agrees."""

    number: int
    first: int
    second: int
    skip: int
    spare: int

    def subsets(self) -> list[tuple[int, ...]]:
        return list(itertools.combinations(range(self.second), self.second - self.skip))


class Bands:
    """Bands of sizes for sets with ``share`` percent or more in common.

    Band i holds sizes low(i) to high(i); the larger partner of a set in band i lies in band i or i + 1.
    """

    def __init__(self, percent: int):
        self.percent = percent
        self.highs = [0]
        self.made: dict[int, Plan] = {}

    def band(self, size: int) -> int:
        while self.highs[-1] < size:
            # the largest partner of the smallest set of this band is its upper end
            low = self.highs[-1] + 1
            self.highs.append(low * 100 // self.percent)
        return int(np.searchsorted(self.highs, size))

    def plans(self, size: int) -> tuple[Plan, Plan]:
        """The plans a set of this size takes part in: as a set of its own band, and as the larger one of a pair."""
        i = self.band(size)
        return self.plan(i), self.plan(i - 1)

    def plan(self, i: int) -> Plan | None:
        if i < 1:
            return None
        if i in self.made:
            return self.made[i]
        high, low = self.highs[i], self.highs[i - 1] + 1
        # |x - y| + |y - x| <= (100 - p) / (100 + p) * (|x| + |y|), with |y| <= |x| * 100 / p
        k = (100 - self.percent) * (high + high * 100 // self.percent) // (100 + self.percent)
        self.made[i] = _plan(i, k, low)
        return self.made[i]


def _plan(number: int, k: int, low: int) -> Plan:
    """The cheapest parameters whose signatures cover enough elements to be rare by chance.

    Large sets share but little by chance, so small parts will do; small ones may consist of
    a common line by half.
    """
    if low >= 200:
        spare = math.ceil(0.1 * (k + 1)) + 2
        return Plan(number, k + 1 + spare, 1, 0, spare)
    best = None
    for skip in range(0, min(k, 4) + 1):
        first = math.ceil((k + 1) / (skip + 1))
        for second in range(skip + 1, skip + 7):
            cost = first * math.comb(second, skip)
            covered = low / first * (second - skip) / second
            rank = (0, cost) if covered >= 8 else (1, -covered)
            if cost <= 96 and (best is None or rank < best[0]):
                best = (rank, Plan(number, first, second, skip, 0))
    return best[1]


def signatures(features: np.ndarray, plan: Plan) -> np.ndarray:
    """``features``: the sorted distinct 64-bit hashes of one set."""
    top, value = features >> np.uint64(32), mix(features ^ np.uint64(0xA5A5A5A5DEADBEEF))
    part = ((top * np.uint64(plan.first)) >> np.uint64(32)).astype(np.int64)
    salt = np.uint64(plan.number << 40)
    if plan.second == 1:
        begin = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        sums, count = np.add.reduceat(value, begin), np.diff(np.append(begin, len(part)))
        held = part[begin]
        full = count > 1
        if plan.first - int(full.sum()) <= plan.spare:
            held, sums = held[full], sums[full]
        elif plan.first > len(held):
            # too many thin parts: the empty ones count as well
            empty = np.setdiff1d(np.arange(plan.first), held)
            held, sums = np.concatenate([held, empty]), np.concatenate([sums, np.zeros(len(empty), np.uint64)])
        return mix(sums ^ mix(salt + held.astype(np.uint64)))
    low = features & np.uint64(0xFFFFFFFF)
    inner = ((low * np.uint64(plan.second)) >> np.uint64(32)).astype(np.int64)
    sums = np.zeros((plan.first, plan.second), np.uint64)
    np.add.at(sums, (part, inner), value)
    subsets = np.array(plan.subsets())
    totals = mix(sums)[:, subsets].sum(axis=2, dtype=np.uint64)
    own = (np.arange(plan.first, dtype=np.uint64)[:, None] << np.uint64(12)) + np.arange(len(subsets), dtype=np.uint64)[None, :]
    return mix(totals ^ mix(salt + (own << np.uint64(1)) + np.uint64(1))).ravel()


#: The least number of cells of a sketch.
LEAST_CELLS = 256


def sketch(features: np.ndarray) -> bytes:
    """Parities of the features over at least as many cells, a power of two: sets differ in at least as many features as cells."""
    cells = max(LEAST_CELLS, 1 << max(len(features) - 1, 0).bit_length())
    odd = np.bincount((mix(features) & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(own: bytes, cells: int = LEAST_CELLS) -> np.ndarray:
    """The sketch of the same set over fewer cells, in 64-bit words."""
    return np.bitwise_xor.reduce(np.frombuffer(own, np.uint64).reshape(-1, cells // 64), axis=0)


def apart(a: bytes, b: bytes) -> int:
    """A lower bound of the number of features in one of two sets only."""
    cells = 8 * min(len(a), len(b))
    return int(np.bitwise_count(folded(a, cells) ^ folded(b, cells)).sum())
