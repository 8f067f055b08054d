"""Benchmark decontamination by spaced seeds.

A mask picks some of the words of a stretch and ignores the others, so two stretches that differ
only in ignored words have equal hashes.  Hashes of training texts that a fixed-size bitmap of
the benchmark's hashes lets through are joined with these; every hit fixes an alignment
of the text with an item, and all words along it, substitutions included, decide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redpen.llm import rowmap, wordhash
from redpen.llm.common import words as word_list, written

LAST = (1 << 63) - 1
#: Word positions that count, of each mask.
MASKS = ((0, 1, 2, 3, 4, 5), (0, 1, 3, 4, 6, 7), (0, 2, 3, 5, 7, 8), (0, 1, 4, 5, 8, 9))
SEED_BITS = 1 << 25


def _seeds(words: np.ndarray, mask: tuple[int, ...], number: int) -> np.ndarray:
    n = max(len(words) - mask[-1], 0)
    out = np.full(n, np.uint64(number + 1), np.uint64)
    for k in mask:
        out = wordhash.mix(out * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n])
    return out


def _seeded(map_, short: list[int]):
    """(d, tie, text) to (seed, d, tie, at): every masked stretch that the map lets through, all of them without a map.

    ``short``: sizes of items shorter than a mask.  Such an item has one seed, over all its words; texts have one for each stretch of these sizes.
    """
    masks = [*enumerate(MASKS), *((len(MASKS) + n, tuple(range(n))) for n in short)]

    def run(batches):
        for batch in batches:
            for piece in wordhash.pieces(batch.column(2), fold=True):
                seeds, at = [], []
                row = np.repeat(np.arange(piece.rows.start, piece.rows.stop), piece.counts())
                last = np.repeat(piece.first[1:], piece.counts())
                size = np.repeat(piece.counts(), piece.counts())
                for number, mask in masks:
                    own = _seeds(piece.words, mask, number)
                    keep = np.arange(len(own)) + mask[-1] < last[: len(own)]
                    if map_ is None and number >= len(MASKS):
                        keep &= size[: len(own)] == len(mask)
                    elif map_ is not None:
                        keep &= rowmap.held(map_.value, (own & np.uint64(SEED_BITS - 1)).astype(np.int64))
                    where = np.flatnonzero(keep)
                    seeds.append(own[where])
                    at.append(where)
                seeds, at = np.concatenate(seeds), np.concatenate(at)
                rows = pa.array(row[at])
                inside = at - piece.first[row[at] - piece.rows.start]
                columns = [pa.array(seeds.view(np.int64)), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(inside.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["seed", "d", "tie", "at"])

    return run


def _best(equal: np.ndarray, least_share: float = 0.7) -> tuple[int, int, int]:
    """Begin, end and equal words of the stretch that has most equal words among those with ``least_share`` of them equal."""
    total = np.concatenate([[0.0], np.cumsum(np.where(equal, 1 - least_share, -least_share))]).round(9)
    same = np.concatenate([[0], np.cumsum(equal)])
    # the first place from which a stretch to each end has the share
    first = np.searchsorted(-np.minimum.accumulate(total), -total)
    end = int(np.argmax(same - same[first]))
    inside = np.flatnonzero(equal[first[end] : end]) + first[end]
    return (int(inside[0]), int(inside[-1]) + 1, len(inside)) if len(inside) else (0, 0, 0)


def _verified(least_words: int, least_share: float):
    """(d, tie, text, list of (item, shift, item text)) to the overlaps that are long enough; the best of each item."""
    def run(batches):
        items: dict[str, np.ndarray] = {}
        for batch in batches:
            tries = batch.column(3)
            offsets = tries.offsets.to_pylist()
            item, shift, item_text = (tries.values.field(k) for k in range(3))
            fresh = [t for t in set(item_text.to_pylist()) if t not in items]
            for piece in wordhash.pieces(pa.array(fresh, pa.string()), fold=True):
                for i, t in enumerate(fresh[piece.rows]):
                    items[t] = piece.words[piece.first[i] : piece.first[i + 1]].copy()
            item, shift, item_text = item.to_pylist(), shift.to_pylist(), item_text.to_pylist()
            rows, found = [], []
            for piece in wordhash.pieces(batch.column(2), fold=True):
                for i in range(piece.rows.stop - piece.rows.start):
                    words, r, best = piece.words[piece.first[i] : piece.first[i + 1]], piece.rows.start + i, {}
                    for j in range(offsets[r], offsets[r + 1]):
                        own = items[item_text[j]]
                        begin, end = max(0, -shift[j]), min(len(own), len(words) - shift[j])
                        equal = words[begin + shift[j] : end + shift[j]] == own[begin:end]
                        needed = min(len(own), least_words, max(8, int(np.ceil(least_share * len(own)))))
                        a, b, same = _best(equal, least_share)
                        if same >= needed:
                            best[item[j]] = max(best.get(item[j], (0,)), (same, -(begin + shift[j] + a), b - a, len(own)))
                    for k, (same, start, length, size) in best.items():
                        rows.append(r)
                        found.append((k, -start, length, same, size))
            if rows:
                take = pa.array(rows)
                columns = [batch.column(0).take(take), batch.column(1).take(take), *(pa.array(c, pa.int64()) for c in zip(*found, strict=True))]
                yield pa.RecordBatch.from_arrays(columns, ["d", "tie", "item_id", "start", "length", "same_words", "item_words"])

    return run


def overlaps(docs: DataFrame, benchmark: DataFrame, least_words: int = 13, least_share: float = 0.7) -> DataFrame:
    """(d, tie, item_id, start, length, same_words, item_words) for every row of ``docs`` that holds a passage of an item.

    A passage is an aligned stretch with ``least_words`` equal words, or ``least_share`` of a shorter item's words
    (8 at least, or the whole of an item with fewer), in which ``least_share`` of the words are equal.
    Items with fewer words than a mask picks are found whole and unchanged only.  Words are compared with A-Z as a-z.  ``d`` is the doc_id (null: the
    largest long) and ``tie`` a hash of the text, which tells rows of one doc_id apart.
    Null texts and items have no words; null item ids count as -1.  Repeated rows give one result.
    """
    base = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("d"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"), F.coalesce("text", F.lit("")).alias("text"))
    items = benchmark.select(F.coalesce("item_id", F.lit(-1)).cast("long").alias("item"), F.xxhash64("text").alias("i_tie"), F.coalesce("text", F.lit("")).alias("item_text"))
    shape = "seed long, d long, tie long, at int"
    picked = len(MASKS[0])
    sizes = items.select(F.size(word_list(F.col("item_text"))).alias("n")).where(f"n between 1 and {picked - 1}").distinct()
    short = sorted(row["n"] for row in sizes.collect())  # fewer than a mask picks
    own = items.select(F.col("item").alias("d"), F.col("i_tie").alias("tie"), "item_text").mapInArrow(_seeded(None, short), shape)
    own = written(own.select("seed", F.col("d").alias("item"), F.col("tie").alias("i_tie"), F.col("at").alias("i_at")).distinct(), "seeds")
    # the map has one size, however large the benchmark is
    map_ = docs.sparkSession.sparkContext.broadcast(rowmap.bitmap(own, F.col("seed").bitwiseAND(F.lit(SEED_BITS - 1)), SEED_BITS))
    hits = base.mapInArrow(_seeded(map_, short), shape)
    tries = hits.join(own, "seed").select("d", "tie", "item", "i_tie", (F.col("at") - F.col("i_at")).alias("shift")).distinct()
    tries = written(tries, "alignments")
    node = F.struct("d", "tie")
    texts = rowmap.kept(base.withColumn("node", node), tries.select(node.alias("node")), "node").drop("node").distinct()
    facts = items.select("item", "i_tie", "item_text").distinct()
    lists = tries.join(facts, ["item", "i_tie"]).groupBy("d", "tie").agg(F.collect_list(F.struct("item", "shift", "item_text")).alias("tries"))
    wide = texts.join(lists, ["d", "tie"]).select("d", "tie", "text", "tries")
    return wide.mapInArrow(_verified(least_words, least_share), "d long, tie long, item_id long, start long, length long, same_words long, item_words long")


def clean(docs: DataFrame, benchmark: DataFrame, least_words: int = 13, least_share: float = 0.7) -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, without a passage of the benchmark.  Null and empty texts stay."""
    found = overlaps(docs, benchmark, least_words, least_share).select("d", "tie").distinct()
    keyed = docs.select(F.struct("*").alias("whole"), F.coalesce("doc_id", F.lit(LAST)).alias("d"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"))
    return keyed.join(found, ["d", "tie"], "left_anti").select("whole.*")


def op7_query(spark, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item whose passage it holds; clean documents have none."""
    from redpen.llm.common import table

    found = overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.nullif("d", F.lit(LAST)).alias("doc_id"), "item_id", "start", "length", "same_words", "item_words")
