"""Near copies by MinHash bands and sequential Bayesian verification.

Sets that share a band of their signatures are candidates.  Signatures are compared a batch of
hashes at a time, and a pair is given up once the posterior chance that it is similar enough falls below
the chosen miss probability.  What is left is confirmed on the full sets (``set_links``).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redpen.llm import wordhash
from redpen.llm.set_links import grouped


@dataclass(frozen=True)
class Plan:
    """``hashes`` in bands of ``rows``: at 80 percent one pair in twenty million shares no band.
    ``batch``: hashes compared at a time.  ``miss``: chance of being similar enough below which a pair is given up.
    ``leaders``: leaders that the sets of a band meet, one after another, before blocks are compared."""

    gram: int = 5
    percent: int = 80
    fold: bool = True
    hashes: int = 128
    rows: int = 4
    batch: int = 16
    miss: float = 1e-6
    leaders: int = 2
    signs_first = True

    def multipliers(self) -> np.ndarray:
        return (wordhash.mix(np.arange(1, self.hashes + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)

    def least_matches(self) -> list[tuple[int, int]]:
        """(hashes compared, equal ones that a pair needs to go on).

        With every similarity equally likely beforehand, m equal ones of n leave a chance of
        P(Binomial(n + 1, percent) <= m) that the similarity reaches ``percent``.
        """
        out, p = [], self.percent / 100
        for n in [*range(self.batch, self.hashes, self.batch), self.hashes]:
            chance, m = 0.0, -1
            while chance < self.miss:
                m += 1
                chance += math.comb(n + 1, m) * p**m * (1 - p) ** (n + 1 - m)
            out.append((n, m))
        return out

    def signs(self, sets: list[np.ndarray]) -> list[bytes]:
        return [sign.tobytes() for sign in signatures(sets, self)]

    def keys(self, sets: list[np.ndarray | None], signs: list[bytes]) -> list[np.ndarray]:
        return list(bands(_of_bytes(signs, self), self))

    def likely(self, sign: bytes, others: list[bytes]) -> np.ndarray:
        return going_on(np.frombuffer(sign, "<u4"), _of_bytes(others, self), self)


def _of_bytes(signs: list[bytes], plan: Plan) -> np.ndarray:
    return np.frombuffer(b"".join(signs), "<u4").reshape(-1, plan.hashes)


def signatures(sets: list[np.ndarray], plan: Plan) -> np.ndarray:
    """One row of least hashes for each of ``sets`` (sorted distinct 64-bit hashes, none empty)."""
    out = np.empty((len(sets), plan.hashes), np.uint32)
    if sets:
        starts = np.cumsum([0, *map(len, sets[:-1])])
        short = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
        for k, odd in enumerate(plan.multipliers()):
            out[:, k] = np.minimum.reduceat(short * odd + np.uint32(k), starts)
    return out


def bands(sigs: np.ndarray, plan: Plan) -> np.ndarray:
    """The key of each band of each signature."""
    parts = sigs.reshape(len(sigs), -1, plan.rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, parts.shape[1] + 1, dtype=np.uint64) << np.uint64(32), parts.shape[:2]).copy()
    for k in range(plan.rows):
        key = wordhash.mix(key + parts[:, :, k])
    return key.view(np.int64)


def going_on(sig: np.ndarray, others: np.ndarray, plan: Plan) -> np.ndarray:
    """Which rows of ``others`` the batches of ``sig`` leave as likely partners."""
    live, equal, at = np.arange(len(others)), np.zeros(len(others), np.int64), 0
    for n, least in plan.least_matches():
        equal = equal + (others[live, at:n] == sig[at:n]).sum(axis=1)
        live, equal = live[equal >= least], equal[equal >= least]
        at = n
    return live


def near_copies(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (the smallest doc_id that links reach, itself included) and kept.

    Null and blank texts have no shingles and no links.  Rows with equal sets are linked, repeated rows included; a row
    with the class's id is kept, so rows that repeat it are too.  Null ids come after all others: a class of nothing else has a null id, and its
    rows are kept.  An empty table gives no rows; columns other than doc_id and text are ignored.
    """
    return grouped(docs, plan).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op12_query(spark, sf_dir: str) -> DataFrame:
    from redpen.llm.common import table

    return near_copies(table(spark, sf_dir, "documents"), Plan(gram=4, percent=80))
