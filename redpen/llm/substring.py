"""Removal of word windows that occur earlier in the corpus, by super-k-mers.

A window is ``width`` consecutive words.  Its minimiser is the least hash among its runs of
``core`` words; consecutive windows with the same minimiser occurrence form a
super-k-mer.  First only (minimiser, place) travels: a super-k-mer whose minimiser occurs
once in the corpus holds no repeated window and stays home.  The others travel as one packed
string each to the bucket of their minimiser, where sorting finds every window's first place.
Windows of a very frequent minimiser travel alone, keyed by their own hash.  Equal rows of a
batch are combined before each shuffle, so a key gets at most one row from each batch.
"""

from __future__ import annotations

import hashlib
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redpen.llm import wordhash
from redpen.llm.batches import whole_keys
from redpen.llm.common import written

LAST = (1 << 63) - 1
#: From this many super-k-mers on, a minimiser's windows travel alone.
HOT = 5000


def _sliding_min(values: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """The least of every ``span`` consecutive values, and the leftmost place it has."""
    low, at, reach = values, np.arange(len(values)), 1
    while reach < span:
        step = min(reach, span - reach)
        left, right = low[: len(low) - step], low[step:]
        take = left <= right
        low, at = np.where(take, left, right), np.where(take, at[: len(at) - step], at[step:])
        reach += step
    return low, at


def _super_kmers(piece: wordhash.Pieces, width: int, core: int) -> tuple[np.ndarray, ...]:
    """text number, first window's word in the text, number of windows, minimiser; for each super-k-mer."""
    none = np.zeros(0, np.int64)
    if len(piece.words) < width:
        return none, none, none, none
    low, at = _sliding_min(wordhash.windows(piece.words, core), width - core + 1)
    text = np.repeat(np.arange(len(piece.first) - 1), np.diff(piece.first))
    start = np.arange(len(low))
    start = start[start + width <= piece.first[text[: len(low)] + 1]]
    if not len(start):
        return none, none, none, none
    own, place = text[start], at[start]
    new = np.ones(len(start), bool)
    new[1:] = (own[1:] != own[:-1]) | (place[1:] != place[:-1])
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(start)))
    return own[begin], start[begin] - piece.first[own[begin]], count, low[start[begin]].view(np.int64)


def _placed(width: int, core: int):
    """Texts to (minimiser, d, tie, at, n): one row per super-k-mer.

    ``n`` is how many the batch has of the minimiser.  A row that is not the batch's first of its
    minimiser has n = 0 and is dealt out by its document instead.
    """
    def run(batches):
        for batch in batches:
            parts = []
            for piece in wordhash.pieces(batch.column(2)):
                text, start, count, low = _super_kmers(piece, width, core)
                parts.append((text + piece.rows.start, start * 64 + count, low))
            if not parts:
                continue
            row, at, low = map(np.concatenate, zip(*parts, strict=True))
            _, first, group, sizes = np.unique(low, return_index=True, return_inverse=True, return_counts=True)
            lead = np.zeros(len(low), bool)
            lead[first] = True
            d, tie = batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row))
            deal = np.where(lead, low, wordhash.mix(row.astype(np.uint64)).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(deal), pa.array(low), d, tie, pa.array(at), pa.array(np.where(lead, sizes[group], 0)), pa.array(sizes[group] > 1)],
                ["deal", "low", "d", "tie", "at", "n", "repeated"],
            )

    return run


def _suspects(batches):
    """Rows sorted by (low, n descending) to those whose minimiser is repeated.

    A minimiser's leads lie next to each other; with two of them, or one that stands for several,
    it is repeated.  The first lead carries the total of all.
    """
    for batch in whole_keys(batches, 1, lambda b: 8 * b.num_rows):
        low, n = batch.column(1).to_numpy(), batch.column(5).to_numpy()
        if not len(low):
            continue
        begin = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
        size = np.diff(np.append(begin, len(low)))
        total = np.add.reduceat(n, begin)
        repeated = batch.column(6).to_numpy(zero_copy_only=False) | np.repeat(total > 1, size)
        first = np.zeros(len(low), np.int64)
        first[begin] = total
        keep = pa.array(repeated)
        out = pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), batch.column(3), batch.column(4), pa.array(first)], ["low", "d", "tie", "at", "total"])
        yield out.filter(keep)


def _packed(width: int):
    """(d, tie, text, list of (at, low, hot)) to rows (key, d, tie, start, n, words); words null: all its windows are repeated."""
    def run(batches):
        for batch in batches:
            lists = batch.column(3)
            offsets = lists.offsets.to_numpy()
            fields = lists.values
            ats, lows, hots = (fields.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            ds, ties = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            texts = batch.column(2)
            out: dict[bytes, tuple] = {}
            extra: list[tuple] = []

            def offer(words: bytes, key: int, d: int, tie: int, start: int, n: int) -> None:
                mine, other = (d, tie, start, n, key), out.get(words)
                if other is None:
                    out[words] = mine
                elif other < mine:
                    extra.append(mine)
                else:
                    out[words] = mine
                    extra.append(other)

            for i in range(batch.num_rows):
                words = (texts[i].as_py() or "").encode().split()
                d, tie = int(ds[i]), int(ties[i])
                for j in range(offsets[i], offsets[i + 1]):
                    start, n = divmod(int(ats[j]), 64)
                    if not hots[j]:
                        offer(b" ".join(words[start : start + n + width - 1]), int(lows[j]), d, tie, start, n)
                        continue
                    for s in range(start, start + n):
                        window = b" ".join(words[s : s + width])
                        offer(window, int.from_bytes(hashlib.blake2b(window, digest_size=8).digest(), "little", signed=True), d, tie, s, 1)
            rows = [(*place, words) for words, place in out.items()] + [(*place, None) for place in extra]
            if rows:
                d, tie, start, n, key, words = zip(*rows, strict=True)
                columns = [pa.array(key, pa.int64()), pa.array(d, pa.int64()), pa.array(tie, pa.int32()), pa.array(start, pa.int32()), pa.array(n, pa.int32()), pa.array(words, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["key", "d", "tie", "start", "n", "words"])

    return run


def _runs(d: np.ndarray, tie: np.ndarray, start: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Stretches of windows, joined where they follow each other."""
    order = np.lexsort((start, tie, d))
    d, tie, start, n = d[order], tie[order], start[order], n[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (tie[1:] != tie[:-1]) | (start[1:] != start[:-1] + n[:-1])
    begin = np.flatnonzero(new)
    total = np.add.reduceat(n, begin) if len(begin) else n
    columns = [pa.array(d[begin]), pa.array(tie[begin]), pa.array(start[begin].astype(np.int32)), pa.array(total.astype(np.int32))]
    return pa.RecordBatch.from_arrays(columns, ["d", "tie", "start", "n"])


def _bucket(width: int):
    """Packed strings sorted by key to stretches (d, tie, start, n) of windows that start earlier elsewhere."""
    def run(batches):
        for batch in whole_keys(batches, 0, lambda b: b.column(5).nbytes + 28 * b.num_rows):
            d, tie, start, n = (batch.column(k).to_numpy() for k in range(1, 5))
            gone = batch.column(5).is_null().to_numpy(zero_copy_only=False)
            packed = batch.column(5).cast(pa.string())
            at = np.flatnonzero(~gone)
            found = [(d[gone], tie[gone], start[gone], n[gone])]
            if len(at):
                hi, lo, own, off = [], [], [], []
                texts = packed.take(pa.array(at))
                for piece, other in zip(wordhash.pieces(texts), wordhash.pieces(texts, salt=1), strict=True):
                    begins = np.repeat(piece.first[:-1], n[at[piece.rows]])
                    count = n[at[piece.rows]]
                    inner = np.arange(len(begins)) - np.repeat(np.cumsum(count) - count, count)
                    hi.append(wordhash.windows(piece.words, width)[begins + inner])
                    lo.append(wordhash.windows(other.words, width)[begins + inner])
                    own.append(np.repeat(at[piece.rows], count))
                    off.append(inner)
                hi, lo, own, off = map(np.concatenate, (hi, lo, own, off))
                place = start[own] + off
                order = np.lexsort((place, tie[own], d[own], lo, hi))
                again = np.zeros(len(order), bool)
                again[1:] = (hi[order][1:] == hi[order][:-1]) & (lo[order][1:] == lo[order][:-1])
                later = order[again]
                found.append((d[own[later]], tie[own[later]], place[later], np.ones(len(later), np.int32)))
            yield _runs(*(np.concatenate([f[k] for f in found]) for k in range(4)))

    return run


def _cut(width: int):
    """(row columns, text, stretches) to the counts and the text that is left."""
    def run(batches):
        for batch in batches:
            texts, stretches = batch.column(1), batch.column(2)
            n_words, n_removed, kept = [], [], []
            for i in range(batch.num_rows):
                words = (texts[i].as_py() or "").encode().split()
                gone = np.zeros(len(words) + 1, np.int64)
                for s in stretches[i].as_py() or ():
                    gone[s["start"]] += 1
                    gone[s["start"] + s["n"] - 1 + width] -= 1
                covered = np.cumsum(gone[:-1]) > 0
                lost = int(covered.sum())
                n_words.append(len(words))
                n_removed.append(lost)
                kept.append(b" ".join(words if not lost else [words[k] for k in np.flatnonzero(~covered)]).decode())
            columns = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept"])

    return run


def deduplicated(docs: DataFrame, width: int = 20, core: int = 6, hot: int = HOT) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept (the words not covered by a repeated window, joined by one space).

    A window is repeated when its words also start earlier: in a smaller doc_id, or earlier in the
    same document.  Rows with equal doc_id and text are one document; rows with equal
    doc_id and other texts follow each other by a hash of the text; null ids come last.  Null and
    blank texts have no words; texts shorter than a window lose none.  An empty table gives
    no rows; columns other than doc_id and text are ignored.
    """
    if not 0 < core <= width or width - core >= 63:
        raise ValueError("core must lie within width, and at most 63 below it")
    base = docs.select("doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("d"), F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumn("tie", F.hash("text"))
    schema = "deal long, low long, d long, tie int, at long, n long, repeated boolean"
    placed = base.select("d", "tie", "text").mapInArrow(_placed(width, core), schema)
    sorted_ = placed.repartition("deal").sortWithinPartitions("low")
    suspects = written(sorted_.mapInArrow(_suspects, "low long, d long, tie int, at long, total long"), "substring-suspects")

    frequent = suspects.where(F.col("total") >= hot).select(F.col("low").alias("hot_low")).distinct()
    marked = suspects.join(frequent, F.col("low") == F.col("hot_low"), "left")
    item = F.struct("at", "low", F.col("hot_low").isNotNull().alias("hot"))
    lists = marked.groupBy(F.col("d").alias("s_d"), F.col("tie").alias("s_tie")).agg(F.collect_set(item).alias("items"))
    texts = base.join(lists, (F.col("d") == F.col("s_d")) & (F.col("tie") == F.col("s_tie"))).select("d", "tie", "text", "items", "doc_id")
    packed = texts.mapInArrow(_packed(width), "key long, d long, tie int, start int, n int, words binary")
    # rows without a string already have their answer, so any bucket will do
    dealt = packed.withColumn("deal", F.when(F.col("words").isNull(), F.xxhash64("d", "start")).otherwise(F.col("key")))
    buckets = dealt.repartition("deal").sortWithinPartitions("key").select("key", "d", "tie", "start", "n", "words")
    stretches = buckets.mapInArrow(_bucket(width), "d long, tie int, start int, n int")
    per_doc = stretches.groupBy(F.col("d").alias("g_d"), F.col("tie").alias("g_tie")).agg(F.collect_list(F.struct("start", "n")).alias("gone"))
    final = base.join(per_doc, (F.col("d") == F.col("g_d")) & (F.col("tie") == F.col("g_tie")), "left").select("doc_id", "text", "gone")
    return final.mapInArrow(_cut(width), "doc_id long, n_words long, n_removed long, kept string")


def op4_query(spark, sf_dir: str) -> DataFrame:
    from redpen.llm.common import table

    out = deduplicated(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
