"""How far the vocabularies of two sources of a language lie apart, and which terms set a source off.

Terms are counted per (language, source).  Each language keeps the terms of enough of its documents,
dealt to blocks of a bounded number of terms.  A group's part of a block is a pair of sorted arrays, term numbers and counts.
Two groups' arrays meet in a pair task (co-grouped by block and by tiles of groups) and a galloping
intersection prices the terms both have, those one has, and the number of those neither has.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redpen.llm.common import written
from redpen.llm.gallop import common as common_places

#: Texts are counted in pieces of about this many bytes; a longer text is one piece.
PIECE_BYTES = 1 << 20
#: A task hands its counts on when it holds this many.
HELD_COUNTS = 300_000
SCALE = 1_000_000_000

_TERM = np.zeros(256, bool)
_TERM[128:] = _TERM[65:91] = _TERM[97:123] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_COUNTS = "lang string, source string, term string, n long, docs long"
_FIELDS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


@dataclass(frozen=True)
class Audit:
    """``least_docs``: documents of a language that a kept term is in.  ``top``: ranks of single terms.
    ``smoothing``: added to every count.  ``block_terms``: kept terms of a language in one block, about.
    ``tile_groups``: groups of a language in one side of a pair task."""

    least_docs: int = 10
    top: int = 10
    smoothing: int = 2
    block_terms: int = 4096
    tile_groups: int = 32


def _piece_counts(data: np.ndarray, starts: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(group, term, occurrences, documents) of texts that begin at ``starts`` in the bytes ``data``."""
    solid = _TERM[data]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    firsts = starts[starts < len(data)]
    begin[firsts] = solid[firsts]
    offsets = np.flatnonzero(begin[solid])
    at = np.flatnonzero(begin)
    letters = _LOWER[data[solid]]
    bounds = np.append(offsets, len(letters)).astype(np.int64)
    terms = pa.LargeStringArray.from_buffers(len(offsets), pa.py_buffer(bounds), pa.py_buffer(letters)).dictionary_encode()
    codes, size = terms.indices.to_numpy().astype(np.int64), max(len(terms.dictionary), 1)
    row = np.searchsorted(starts, at, "right") - 1
    each, times = np.unique(row * size + codes, return_counts=True)
    key = group[each // size] * size + each % size
    order = np.argsort(key, kind="stable")
    key, times = key[order], times[order]
    cut = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    n = np.add.reduceat(times, cut) if len(cut) else np.zeros(0, np.int64)
    return key[cut] // size, terms.dictionary.take(pa.array(key[cut] % size)), n, np.diff(np.append(cut, len(key)))


def _counted(batches):
    """(lang, source, text) to (lang, source, term, occurrences, documents), combined inside the task."""
    held: list[pa.Table] = []

    def combined() -> pa.Table:
        whole = pa.concat_tables(held).combine_chunks()
        sums = whole.group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
        return pa.table([sums[k] for k in ("lang", "source", "term", "n_sum", "docs_sum")], schema=_FIELDS)

    for batch in batches:
        text = batch.column(2).cast(pa.large_string())
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        data = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] is not None else np.zeros(0, np.uint8)
        names = pa.StructArray.from_arrays([batch.column(0), batch.column(1)], ["lang", "source"]).to_pylist()
        numbers: dict[tuple[str, str], int] = {}
        group = np.array([numbers.setdefault((x["lang"], x["source"]), len(numbers)) for x in names], np.int64)
        langs, sources = (pa.array([x[k] for x in numbers], pa.string()) for k in range(2))
        at = 0
        while at < len(text):
            to = min(max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE_BYTES, "right")) - 1), len(text))
            owner, term, n, docs = _piece_counts(data[offsets[at] : offsets[to]], offsets[at:to] - offsets[at], group[at:to])
            owner = pa.array(owner)
            held.append(pa.table([langs.take(owner), sources.take(owner), term.cast(pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())], schema=_FIELDS))
            at = to
            if sum(map(len, held)) > 2 * HELD_COUNTS:
                held = [combined()]
                if len(held[0]) > HELD_COUNTS:
                    yield from held.pop().to_batches(1 << 16)
    if held:
        yield from combined().to_batches(1 << 16)
    # the worker serves other tasks: what this one needed goes back
    held.clear()
    pa.default_memory_pool().release_unused()


def term_counts(docs: DataFrame, audit: Audit = Audit()) -> DataFrame:
    """lang, source, term, n for the kept terms, with the language's n as ``lang_n`` and ``first`` in one source of the language."""
    rows = docs.select(*(F.coalesce(F.col(k), F.lit("")).alias(k) for k in ("lang", "source", "text")))
    partial = rows.mapInArrow(_counted, _COUNTS).repartition("lang", "term")
    sums = partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    alike = Window.partitionBy("lang", "term")
    whole = sums.select(
        "lang", "source", "term", "n", F.sum("n").over(alike).alias("lang_n"), F.sum("docs").over(alike).alias("lang_docs"), (F.min("source").over(alike) == F.col("source")).alias("first")
    )
    return whole.where(F.col("lang_docs") >= audit.least_docs).drop("lang_docs")


def groups(docs: DataFrame, counts: DataFrame, audit: Audit = Audit()) -> DataFrame:
    """Every (lang, source): its number ``no`` in the language, the language's number of kept terms ``v``, and the sizes ``m`` and ``lang_m`` that shares are taken of."""
    named = docs.select(*(F.coalesce(F.col(k), F.lit("")).alias(k) for k in ("lang", "source"))).distinct()
    own = counts.groupBy("lang", "source").agg(F.sum("n").alias("own_n"), F.sum(F.col("first").cast("long")).alias("firsts"))
    joined = named.join(own, ["lang", "source"], "left").fillna(0, ["own_n", "firsts"])
    lang = Window.partitionBy("lang")
    return joined.select(
        "lang",
        "source",
        (F.row_number().over(lang.orderBy("source")) - 1).alias("no"),
        F.sum("firsts").over(lang).alias("v"),
        (F.col("own_n") + audit.smoothing * F.sum("firsts").over(lang)).alias("m"),
        (F.sum("own_n").over(lang) + audit.smoothing * F.sum("firsts").over(lang)).alias("lang_m"),
    )


def _share(n: Column, m: Column, audit: Audit) -> Column:
    """1 + floor(SCALE * (n + smoothing) / m), exactly, at any size of the counts."""
    whole = F.lit(SCALE).cast("decimal(10,0)") * (n + audit.smoothing).cast("decimal(20,0)")
    return 1 + F.call_function("div", whole, m.cast("decimal(20,0)"))


def _price(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def shares(counts: np.ndarray, m: int, smoothing: int) -> np.ndarray:
    """As ``_share``: long division by nine decimal digits, so that no product leaves 64 bits."""
    rest = counts.astype(np.int64) + smoothing
    out = rest // m
    for _ in range(9):
        rest = (rest % m) * 10
        out = out * 10 + rest // m
    return out + 1


def prices(p: np.ndarray, q: np.ndarray) -> int:
    apart = p - q
    return int((apart * apart // (p + q)).sum())


def _pair_task(smoothing: int):
    """Two tiles of groups of one block to (lang, a, b, value of the terms that a or b has, number of these)."""
    def rows(side: pa.Table) -> list[tuple]:
        side = side.combine_chunks()
        out = []
        for no, m, ids, counts in zip(*(side.column(k).chunk(0) if len(side) else [] for k in range(4, 8)), strict=True):
            ids, counts, m = np.asarray(ids.values, np.int64), np.asarray(counts.values, np.int64), m.as_py()
            if m:
                out.append((no.as_py(), m, ids, shares(counts, m, smoothing), shares(np.zeros(1, np.int64), m, smoothing)[0]))
            else:
                out.append((no.as_py(), m, ids, counts, 0))
        return out

    def run(key, left, right):
        lang, own, other = key[0].as_py(), rows(left), rows(right)
        out = []
        for a, m, a_ids, p, p_none in own:
            for b, _, b_ids, q, q_none in other:
                if a >= b:
                    continue
                value, seen = 0, 0
                if m:
                    i, j = common_places(a_ids, b_ids)
                    a_only, b_only = np.ones(len(a_ids), bool), np.ones(len(b_ids), bool)
                    a_only[i] = b_only[j] = False
                    value = prices(p[i], q[j]) + prices(p[a_only], q_none) + prices(p_none, q[b_only])
                    seen = len(a_ids) + len(b_ids) - len(i)
                out.append((lang, a, b, value, seen))
        columns = [*zip(*out)] or [[]] * 5
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
        return pa.table([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["lang", "a", "b", "value", "seen"])

    return run


def _arrays(counts: DataFrame, found: DataFrame, audit: Audit) -> DataFrame:
    """One row for every group and block of its language: no, m, ids (ascending) and counts; both empty where the group has no term of the block."""
    blocks = F.greatest(F.ceil(F.col("v") / audit.block_terms), F.lit(1)).cast("int")
    rows = counts.join(found.select("lang", "source", "no", "v"), ["lang", "source"])
    rows = rows.select("lang", F.pmod(F.xxhash64("term"), blocks).cast("int").alias("block"), "no", "term", "n")
    numbered = rows.select("lang", "block", "no", "n", F.dense_rank().over(Window.partitionBy("lang", "block").orderBy("term")).alias("id"))
    lists = numbered.groupBy("lang", "block", "no").agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("x"))
    every = found.select("lang", "no", "m", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
    joined = every.join(lists, ["lang", "block", "no"], "left")
    ids, n = (F.coalesce(F.col(f"x.{k}"), F.array().cast(f"array<{kind}>")) for k, kind in (("id", "int"), ("n", "long")))
    return joined.select("lang", "block", "no", "m", ids.alias("ids"), n.alias("counts"))


def pair_values(counts: DataFrame, found: DataFrame, audit: Audit = Audit()) -> DataFrame:
    """lang, a, b (numbers of groups, a < b), value: the price summed over all kept terms of the language."""
    arrays = written(_arrays(counts, found, audit), "divergence-arrays")
    tiles = found.groupBy("lang").agg(F.floor(F.max("no") / audit.tile_groups).cast("int").alias("last"))
    tile = F.floor(F.col("no") / audit.tile_groups).cast("int")
    dealt = arrays.join(tiles, "lang").withColumn("tile", tile)
    left = dealt.select("*", F.explode(F.sequence("tile", "last")).alias("to")).select("lang", "block", F.col("tile").alias("row"), F.col("to").alias("col"), "no", "m", "ids", "counts")
    right = dealt.select("*", F.explode(F.sequence(F.lit(0), "tile")).alias("to")).select("lang", "block", F.col("to").alias("row"), F.col("tile").alias("col"), "no", "m", "ids", "counts")
    right = right.toDF(*(f"other_{k}" for k in right.columns))
    parts = left.groupBy(*left.columns[:4]).cogroup(right.groupBy(*right.columns[:4])).applyInArrow(_pair_task(audit.smoothing), "lang string, a int, b int, value long, seen long")
    sums = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    none = F.when(F.col("m") > 0, _share(F.lit(0), F.col("m"), audit)).otherwise(1)
    sides = [found.select("lang", F.col("no").alias(k), none.alias(f"{k}_none"), "v") for k in ("a", "b")]
    whole = sums.join(sides[0], ["lang", "a"]).join(sides[1].drop("v"), ["lang", "b"])
    absent = (F.col("v") - F.col("seen")) * _price(F.col("a_none"), F.col("b_none"))
    return whole.select("lang", "a", "b", (F.col("value") + absent).alias("value"))


def divergence(docs: DataFrame, audit: Audit = Audit()) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source lies from the others of its language, and its leading terms.

    Null text, lang and source count as empty strings.  A row is a document, so repeated rows and ids
    count each.  Groups without terms are compared by their smoothed shares; in a language without kept terms all
    values are 0.  Ties are ranked by the item.  An empty table gives no rows; other columns, whatever their names, are ignored.
    """
    counts = written(term_counts(docs, audit), "divergence-counts")
    found = written(groups(docs, counts, audit), "divergence-groups")
    pairs = pair_values(counts, found, audit)
    names = found.select("lang", "no", "source")
    both = pairs.select("lang", "value", F.explode(F.array(F.struct(F.col("a").alias("no"), F.col("b").alias("other")), F.struct(F.col("b").alias("no"), F.col("a").alias("other")))).alias("x"))
    both = both.select("lang", "value", "x.no", "x.other").join(names, ["lang", "no"])
    both = both.join(names.select("lang", F.col("no").alias("other"), F.col("source").alias("item")), ["lang", "other"])
    sized = counts.join(found.select("lang", "source", "m", "lang_m"), ["lang", "source"])
    p, q = _share(F.col("n"), F.col("m"), audit), _share(F.col("lang_n"), F.col("lang_m"), audit)
    terms = sized.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q").withColumn("value", _price(F.col("p"), F.col("q")))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    parts = [rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", rank) for part, rows in (("pair", both), ("term", terms))]
    return parts[0].unionByName(parts[1].where(F.col("rank") <= audit.top))


def op13_query(spark, sf_dir: str) -> DataFrame:
    from redpen.llm.common import table

    return divergence(table(spark, sf_dir, "documents"))
