"""Similarity join of documents on their word n-grams, by PartEnum signatures.

Rows that share a signature are candidates; exact set sizes decide.  Sketches that bound the difference
of two sets from below keep most of the unlike pairs from being compared in full (``set_links``).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from redpen.llm import part_enum
from redpen.llm.set_links import first_of_each, grouped


@dataclass(frozen=True)
class Plan:
    """``percent``: shared shingles as a percentage of all shingles of both.  ``fold``: A-Z count as a-z."""

    gram: int = 5
    percent: int = 80
    fold: bool = True
    leaders: int = 1
    signs_first = False

    def signs(self, sets: list[np.ndarray]) -> list[bytes]:
        """The size of each set, its sketch over the least number of cells, and its sketch."""
        sketches = [part_enum.sketch(own) for own in sets]
        return [np.int64(len(own)).tobytes() + part_enum.folded(k).tobytes() + k for own, k in zip(sets, sketches, strict=True)]

    def keys(self, sets: list[np.ndarray], signs: list[bytes | None]) -> list[np.ndarray]:
        bands = part_enum.Bands(self.percent)
        return [np.concatenate([part_enum.signatures(own, p) for p in bands.plans(len(own)) if p]).view(np.int64) for own in sets]

    def likely(self, sign: bytes, others: list[bytes]) -> np.ndarray:
        head = 8 + part_enum.LEAST_CELLS // 8
        heads = np.frombuffer(b"".join(x[:head] for x in [sign, *others]), np.uint64).reshape(-1, head // 8)
        sizes, shorts = heads[:, 0].astype(np.int64), heads[:, 1:]
        left = np.flatnonzero(self._possible(sizes[0], sizes[1:], np.bitwise_count(shorts[0] ^ shorts[1:]).sum(axis=-1)))
        # whole sketches where the short ones do not tell
        apart = np.array([part_enum.apart(sign[head:], others[i][head:]) for i in left.tolist()], np.int64)
        return left[self._possible(sizes[0], sizes[1:][left], apart)]

    def _possible(self, a_size, b_size, apart):
        """Whether two sets may be similar enough, by their sizes and a lower bound of their difference."""
        low, high = np.minimum(a_size, b_size), np.maximum(a_size, b_size)
        return (low * 100 >= high * self.percent) & (apart * (100 + self.percent) <= (100 - self.percent) * (low + high))


def joined(docs: DataFrame, gram: int = 5, percent: int = 80, fold: bool = True) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (the smallest doc_id that links reach, itself included).

    Null and blank texts have no shingles and no links.  Null ids count as one id after all others; a class of
    nothing else has a null id.  An empty table gives no rows; columns other than doc_id and text are ignored.
    """
    return grouped(docs, Plan(gram, percent, fold))


def representatives(docs: DataFrame, gram: int = 5, percent: int = 80, fold: bool = True) -> DataFrame:
    """The rows of ``docs``, all columns, that are the least of their component; rows without links stay.

    Of rows equal in doc_id and text one stays.  Columns may have any names.
    """
    return first_of_each(docs, Plan(gram, percent, fold))


def op1_query(spark, sf_dir: str) -> DataFrame:
    from redpen.llm.common import table

    return joined(table(spark, sf_dir, "documents"), gram=4, percent=85)
