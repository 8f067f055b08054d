"""A bitmap of chosen rows, of one fixed size, that keeps most other texts out of a shuffle.

The map may let rows through that were not chosen; an exact join follows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The map takes an eighth as many bytes, whatever it holds.
MAP_BITS = 1 << 23
_CHUNK = 1 << 15


def spot(key: Column, bits: int = MAP_BITS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bits)).cast("long")


def bitmap(keys: DataFrame, at: Column, bits: int = MAP_BITS) -> bytes:
    """A bit for the place ``at`` of every row of ``keys``."""
    placed = keys.select(at.alias("s"))
    chunks = placed.groupBy(F.floor(F.col("s") / _CHUNK).alias("chunk")).agg(F.bitmap_construct_agg(F.col("s") % _CHUNK).alias("bits"))
    whole = bytearray(bits // 8)
    for row in chunks.toLocalIterator():
        begin = row["chunk"] * (_CHUNK // 8)
        whole[begin : begin + len(row["bits"])] = row["bits"]
    return bytes(whole)


def held(bits, at: np.ndarray) -> np.ndarray:
    """Which of the places ``at`` are set."""
    cells = np.frombuffer(bits, np.uint8)
    return (cells[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def kept(rows: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """``rows`` whose ``key`` may be in ``chosen``."""
    map_ = rows.sparkSession.sparkContext.broadcast(bitmap(chosen, spot(F.col(key))))
    at = len(rows.columns)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(held(map_.value, batch.column(at).to_numpy()))).select(list(range(at)))

    return rows.withColumn("spot_", spot(F.col(key))).mapInArrow(run, rows.schema)
