"""Links between the word-shingle sets of documents that share a key, and what they join.

A scheme gives each set its keys; sets that are similar enough share one.  Documents with equal sets are
one set.  Every set first meets one leader of its key, the same for all keys of a group as far as possible.
Keys whose sets then still lie in several components get another leader.  What is left is first compared by signs
alone, key by key, which tells which components may yet be joined.  Their sets are dealt to groups of such
components, each set to one group, and compared there in full; groups too large for a
task are dealt by key, to blocks, and a pair is looked at under the least key that both have.  Pairs count
only while their components are apart, so no task gives more links than it has sets.  Signs, short and cheap to compare, leave out pairs; the others are confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redpen.llm import rowmap, wordhash
from redpen.llm.batches import whole_keys
from redpen.llm.common import discard, release, written

LAST = (1 << 63) - 1
#: Sets that meet in one task, and partners of a leader.
BLOCK = 1024


class Scheme(Protocol):
    """``gram``, ``fold``: the shingles.  ``percent``: shared members as a percentage of all members of both.
    ``leaders``: leaders that the sets of a key meet, one after another.  ``signs_first``: the keys are made of
    the signs, which are therefore made of all sets and not only of those with a key in common."""

    gram: int
    fold: bool
    percent: int
    leaders: int
    signs_first: bool

    def signs(self, sets: list[np.ndarray]) -> list[bytes]:
        """A sign of each set (sorted distinct 64-bit hashes, none empty)."""

    def keys(self, sets: list[np.ndarray | None], signs: list[bytes | None]) -> list[np.ndarray]:
        """The keys of each set; ``sets`` or ``signs`` holds None where the scheme does not need them."""

    def likely(self, sign: bytes, others: list[bytes]) -> np.ndarray:
        """The places of ``others`` that may be similar enough."""


def feature_sets(text: pa.Array, gram: int, fold: bool) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes of its ``gram``-word shingles); a text with fewer words is one shingle."""
    for piece in wordhash.pieces(text, fold):
        hashes = wordhash.windows(piece.words, gram)
        for i, (a, b) in enumerate(zip(piece.first[:-1].tolist(), piece.first[1:].tolist(), strict=True)):
            if b - a >= gram:
                own = np.sort(hashes[a : b - gram + 1])
                yield piece.rows.start + i, own[np.append(True, own[1:] != own[:-1])]
            else:
                yield piece.rows.start + i, wordhash.windows(piece.words[a:b], b - a) if b > a else np.zeros(0, np.uint64)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted distinct sets share ``percent`` of all their members."""
    low, high = sorted((len(a), len(b)))
    if 100 * low < percent * high:
        return False
    both = np.sort(np.concatenate([a, b]))
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def _names(own: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    x = wordhash.mix(own)
    return int(x.sum(dtype=np.uint64).view(np.int64)), int(wordhash.mix(x ^ np.uint64(0xA5A5A5A5DEADBEEF)).sum(dtype=np.uint64).view(np.int64))


def _pieces(text: pa.Array, scheme: Scheme, most: int = 400_000) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Rows and sets of the texts that have words, some at a time."""
    rows, sets, size = [], [], 0
    for i, own in feature_sets(text, scheme.gram, scheme.fold):
        if len(own):
            rows.append(i)
            sets.append(own)
            size += len(own)
        if size > most:
            yield rows, sets
            rows, sets, size = [], [], 0
    if rows:
        yield rows, sets


def _described(scheme: Scheme):
    """(doc_id, d, tie, text) with the size and name of the text's set, and its sign if keys are made of it; size 0: no words."""
    def run(batches):
        for batch in batches:
            n, h1, h2 = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            signs = [b""] * batch.num_rows
            for rows, sets in _pieces(batch.column(3), scheme):
                for i, own, sign in zip(rows, sets, scheme.signs(sets) if scheme.signs_first else [b""] * len(rows), strict=True):
                    n[i], signs[i] = len(own), sign
                    h1[i], h2[i] = _names(own)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n), pa.array(h1), pa.array(h2), pa.array(signs, pa.binary())], ["doc_id", "d", "tie", "n", "h1", "h2", "sign"])

    return run


def _keyed(scheme: Scheme):
    """(text) to (key, h1); a set is given once for each batch, however many texts of it have it."""
    def run(batches):
        for batch in batches:
            seen: set[tuple[int, int]] = set()
            for _, sets in _pieces(batch.column(0), scheme):
                names = [_names(own) for own in sets]
                new = [i for i, name in enumerate(names) if not (name in seen or seen.add(name))]
                if not new:
                    continue
                keys = scheme.keys([sets[i] for i in new], [None] * len(new))
                h1 = np.repeat([names[i][0] for i in new], [len(k) for k in keys])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(h1)], ["key", "h1"])

    return run


def _keyed_signs(scheme: Scheme):
    """(h1, sign) to (key, h1)."""
    def run(batches):
        for batch in batches:
            keys = scheme.keys([None] * batch.num_rows, batch.column(1).to_pylist())
            at = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)), batch.column(0).take(pa.array(at))], ["key", "h1"])

    return run


def _shared(batches):
    """Rows sorted by (key, h1) to those of keys that several sets have, each once.

    Only the first row of the current key is held, however many rows it has.
    """
    key0 = first0 = last0 = 0
    begun = several = False
    for batch in batches:
        key, h1 = (batch.column(k).to_numpy() for k in range(2))
        if not len(key):
            continue
        same = np.append(begun and key[0] == key0, key[1:] == key[:-1])
        again = same & np.append(h1[0] == last0, h1[1:] == h1[:-1])
        # the key's rows after the first set: all but repeats; the first comes out with the second
        starts = np.flatnonzero(~same)
        group = np.cumsum(~same)
        firsts = np.append(first0, h1[starts])[group]
        later = same & ~again & (h1 != firsts)
        opens = later.copy()
        before = np.cumsum(later)
        base = np.append(several, np.zeros(len(starts), bool))[group]
        opens &= (before - np.append(0, np.append(0, before)[starts])[group] == 1) & ~base
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([key[later], key[opens]])), pa.array(np.concatenate([h1[later], firsts[opens]]))], ["key", "h1"])
        tail = group == group[-1]
        several = bool(base[-1]) or bool(later[tail].any())
        begun, key0, first0, last0 = True, key[-1], firsts[-1], h1[-1]


def _named(scheme: Scheme):
    """(d, text) to (d, h1, h2, sign, members): sign and sorted set of each text that has words."""
    def run(batches):
        for batch in batches:
            for rows, sets in _pieces(batch.column(1), scheme):
                names = [_names(own) for own in sets]
                columns = [batch.column(0).take(pa.array(rows)), *(pa.array([x[k] for x in names], pa.int64()) for k in range(2))]
                columns += [pa.array(scheme.signs(sets), pa.binary()), pa.array([own.tobytes() for own in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["d", "h1", "h2", "sign", "members"])

    return run


def _led(check):
    """Rows (a, salt, partner, b, data) sorted by the first three to the pairs (a, b) that ``check`` lets through.

    The leader's own row, without a partner, comes first; only that one is held.
    """
    def run(batches):
        data = None
        for batch in batches:
            partner = batch.column(2).to_numpy(zero_copy_only=False)
            cuts = np.append(np.flatnonzero(~partner), batch.num_rows)
            begin = 0
            for stop in cuts.tolist():
                if stop > begin:
                    own = batch.slice(begin, stop - begin)
                    yield own.select(["a", "b"]).take(pa.array(check(data, own.column(4)), pa.int64()))
                if stop < batch.num_rows:
                    data = batch.column(4)[stop].as_py()
                begin = stop + 1

    return run


def _across(scheme: Scheme):
    """The sets of a group, or of one or two blocks of an open key, to links (a, b) between components, no more than are needed to join them."""
    def run(key, table):
        by_key, here, low, high = (k.as_py() for k in key)
        table = table.combine_chunks().sort_by([("part", "ascending"), ("e", "ascending")])
        e, comp, part = (table[k].to_numpy() for k in ("e", "comp", "part"))
        signs, members = table["sign"].to_pylist(), [np.frombuffer(x, np.uint64) for x in table["members"].to_pylist()]
        _, root = np.unique(comp, return_inverse=True)
        smaller = [k[k < here] for k in scheme.keys(members, signs)] if by_key else [np.zeros(0, np.int64)] * len(e)
        row = np.repeat(np.arange(len(e)), [len(k) for k in smaller])
        _, code = np.unique(np.concatenate(smaller) if smaller else np.zeros(0, np.int64), return_inverse=True)
        order = np.argsort(code, kind="stable")
        begins = np.searchsorted(code[order], np.arange(code.max(initial=-1) + 2))
        of_row = np.searchsorted(row, np.arange(len(e) + 1))
        left, right = [], []
        for x in range(len(e)):
            others = np.arange(x + 1, len(e))
            others = others[root[others] != root[x]]
            if low != high:
                others = others[part[others] != part[x]]
            if not len(others):
                continue
            met = np.zeros(len(e), bool)
            for c in code[of_row[x] : of_row[x + 1]].tolist():
                met[row[order[begins[c] : begins[c + 1]]]] = True
            others = others[~met[others]]
            others = others[scheme.likely(signs[x], [signs[y] for y in others.tolist()])] if len(others) else others
            for y in others.tolist():
                if root[x] != root[y] and similar(members[x], members[y], scheme.percent):
                    left.append(e[x])
                    right.append(e[y])
                    root[root == root[y]] = root[x]
        return pa.table([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return run


def _may_join(scheme: Scheme):
    """Rows (deal, key, low, high, e, comp, part, sign) sorted by deal to (key, a, b): components that the signs let be joined.

    A row for each join of components inside a deal, not for each pair of sets that allows it.
    """
    def edges_of(low, high, comp, part, signs):
        _, root = np.unique(comp, return_inverse=True)
        for x in range(len(comp)):
            others = np.arange(x + 1, len(comp))
            others = others[root[others] != root[x]]
            if low != high:
                others = others[part[others] != part[x]]
            if len(others):
                for y in others[scheme.likely(signs[x], [signs[y] for y in others.tolist()])].tolist():
                    if root[x] != root[y]:
                        yield x, y
                        root[root == root[y]] = root[x]

    def run(batches):
        for batch in whole_keys(batches, 0, lambda b: 100 * b.num_rows + b.column(7).nbytes):
            deal, key, low, high, comp, part = (batch.column(k).to_numpy() for k in (0, 1, 2, 3, 5, 6))
            signs = batch.column(7).to_pylist()
            cuts = np.append(np.flatnonzero(np.append(True, deal[1:] != deal[:-1])), len(deal)).tolist()
            left, right = [], []
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                # deals that fall together by their hash are told apart by the key and blocks
                names = {*zip(key[i:j].tolist(), low[i:j].tolist(), high[i:j].tolist(), strict=True)}
                for k, a, b in names:
                    own = i + np.flatnonzero((key[i:j] == k) & (low[i:j] == a) & (high[i:j] == b)) if len(names) > 1 else np.arange(i, j)
                    for x, y in edges_of(a, b, comp[own], part[own], [signs[n] for n in own.tolist()]):
                        left.append(own[x])
                        right.append(own[y])
            left, right = np.array(left, np.int64), np.array(right, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key[left]), pa.array(comp[left]), pa.array(comp[right])], ["key", "a", "b"])

    return run


def components(links: DataFrame) -> DataFrame:
    """(node, comp) of every node in ``links`` (a, b): the least node it is joined to by links.

    Large-star and small-star steps in turn: every node's neighbours are tied to the least of
    them until nothing changes; the number of rounds grows with the logarithm of the largest component.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("m_u")).agg(F.least(F.min("v"), F.col("m_u")).alias("m"))
        large = both.join(least, F.col("u") == F.col("m_u")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.where("u != v").distinct(), "edges")
        least = large.groupBy(F.col("u").alias("m_u")).agg(F.min("v").alias("m"))
        small = large.join(least, F.col("u") == F.col("m_u")).select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        small = written(small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u != v").distinct(), "edges")
        discard(edges, large)
        # all stars: no node has two parents, and no parent has one
        parents = small.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        chains = small.join(small.select(F.col("u").alias("p")), F.col("v") == F.col("p"), "left_semi")
        edges = small
        if parents.isEmpty() and chains.isEmpty():
            break
    tops = edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(tops)


class SetLinks:
    """Sets of the documents ``docs`` (doc_id, text), and the links between them.

    ``rows``: doc_id, d, tie (which tell rows apart), n (size of the set), h1, h2 (its name).  ``sets``: e (a number), h1, h2, d (least doc_id).
    """

    def __init__(self, docs: DataFrame, scheme: Scheme):
        self.scheme, self.spark = scheme, docs.sparkSession
        text = F.coalesce("text", F.lit(""))
        doc_id = F.col("doc_id").cast("long")
        self.base = docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(LAST)).alias("d"), F.xxhash64(text).alias("tie"), text.alias("text"))
        self.rows = written(self.base.mapInArrow(_described(scheme), "doc_id long, d long, tie long, n long, h1 long, h2 long, sign binary"), "sets-rows")
        sets = self.rows.where("n > 0").groupBy("h1", "h2").agg(F.min("d").alias("d"), *[F.first("sign").alias("sign")] * scheme.signs_first)
        self.sets = written(sets.select(F.monotonically_increasing_id().alias("e"), "*"), "sets")

    def _open_keys(self) -> DataFrame:
        """(key, e): the keys that several sets have, and their sets."""
        if self.scheme.signs_first:
            keyed = self.sets.select("h1", "sign").mapInArrow(_keyed_signs(self.scheme), "key long, h1 long")
        else:
            keyed = self.base.select("text").mapInArrow(_keyed(self.scheme), "key long, h1 long")
        shared = keyed.repartition("key").sortWithinPartitions("key", "h1").mapInArrow(_shared, "key long, h1 long")
        shared = written(shared, "sets-shared")
        release(self.spark)
        # one half of the name is enough to meet by: what it does not tell apart is compared in full
        found = written(shared.join(self.sets.select("h1", "e"), "h1").select("key", "e"), "sets-keys")
        discard(shared)
        release(self.spark)
        return found

    def _features(self, chosen: DataFrame) -> DataFrame:
        """(e, sign, members) of the sets ``chosen``, each from one of its documents."""
        names = self.sets.select("e", "h1", "h2", "d").join(chosen, "e", "left_semi")
        texts = rowmap.kept(self.base.select("d", "text"), names.select("d"), "d")
        members = texts.mapInArrow(_named(self.scheme), "d long, h1 long, h2 long, sign binary, members binary")
        return members.join(names, ["d", "h1", "h2"]).select("e", "sign", "members").dropDuplicates(["e"])

    def _met(self, pairs: DataFrame, features: DataFrame, data: str, check) -> DataFrame:
        """The pairs (a, b) that ``check`` lets through by their ``data``.  A leader's row goes once to each task that has partners of it."""
        # only leaders of many are named, so few that Spark need not deal the pairs by leader to meet them
        many = pairs.groupBy(F.col("a").alias("m_a")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts")).where("parts > 1")
        dealt = pairs.join(many, F.col("a") == F.col("m_a"), "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).alias("salt"))
        own = features.select(F.col("e").alias("f_e"), F.col(data).alias("data"))
        partners = dealt.join(own, F.col("b") == F.col("f_e")).select("a", "salt", F.lit(True).alias("partner"), "b", "data")
        leaders = dealt.select("a", "salt").distinct().join(own, F.col("a") == F.col("f_e")).select("a", "salt", F.lit(False).alias("partner"), F.col("a").alias("b"), "data")
        rows = leaders.unionByName(partners).repartition("a", "salt").sortWithinPartitions("a", "salt", "partner")
        return rows.mapInArrow(_led(check), "a long, b long")

    def _confirmed(self, pairs: DataFrame, features: DataFrame) -> DataFrame:
        scheme = self.scheme

        def likely(lead, column):
            return scheme.likely(lead, column.to_pylist())

        def alike(lead, column):
            mine = np.frombuffer(lead, np.uint64)
            return [i for i, x in enumerate(column.to_pylist()) if similar(mine, np.frombuffer(x, np.uint64), scheme.percent)]

        pairs = written(pairs, "sets-pairs")
        left = written(self._met(pairs, features, "sign", likely), "sets-likely")
        found = written(self._met(left, features, "members", alike), "sets-links")
        discard(pairs, left)
        release(self.spark)
        return found

    def links(self) -> DataFrame:
        """(a, b) of confirmed links between sets that join the same sets as all links do."""
        keys = self._open_keys()
        features = written(self._features(keys.select("e").distinct()), "sets-features")
        release(self.spark)
        leads = keys.groupBy(F.col("key").alias("l_key")).agg(F.min("e").alias("a"))
        stars = keys.join(leads, F.col("key") == F.col("l_key")).where("a < e").select("a", F.col("e").alias("b")).distinct()
        found = self._confirmed(stars, features)
        spent = [keys, features]
        for turn in range(1, self.scheme.leaders + 1):
            comps = written(components(found), "sets-components")
            placed = keys.join(comps.withColumnRenamed("node", "c_e"), F.col("e") == F.col("c_e"), "left").select("key", "e", F.coalesce("comp", "e").alias("comp"))
            apart = placed.groupBy(F.col("key").alias("o_key")).agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("n"), F.min(F.struct(F.xxhash64("e", F.lit(turn)), "e", "comp")).alias("lead")).where("low < high")
            open_ = written(placed.join(apart, F.col("key") == F.col("o_key")).select("key", "e", "comp", "n", "lead"), "sets-open")
            spent += [comps, open_]
            if open_.isEmpty():
                break
            if turn < self.scheme.leaders:
                pairs = open_.where("comp != lead.comp").select(F.least("e", "lead.e").alias("a"), F.greatest("e", "lead.e").alias("b")).distinct()
                more = self._confirmed(pairs, features)
            else:
                more = self._joined(open_, features)
            found = found.unionByName(more)
        discard(*spent)
        return found

    def _joined(self, open_: DataFrame, features: DataFrame) -> DataFrame:
        """Links between the components of open keys."""
        parts = F.ceil(F.col("n") / BLOCK).cast("int")
        dealt = open_.select("key", "e", "comp", parts.alias("parts"), F.pmod(F.xxhash64("e"), parts).cast("int").alias("part"))
        dealt = dealt.select("key", "e", "comp", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
        dealt = dealt.select("key", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "e", "comp", "part")
        signs = features.select(F.col("e").alias("f_e"), "sign")
        signed = dealt.join(signs, F.col("e") == F.col("f_e")).select(F.xxhash64("key", "low", "high").alias("deal"), "key", "low", "high", "e", "comp", "part", "sign")
        signed = signed.repartition("deal").sortWithinPartitions("deal")
        edges = written(signed.mapInArrow(_may_join(self.scheme), "key long, a long, b long"), "sets-edges")
        release(self.spark)

        groups = written(components(edges.select("a", "b").distinct()).select(F.col("node").alias("g_comp"), F.col("comp").alias("g")), "sets-groups")
        sets = open_.select("e", "comp").distinct().join(groups, F.col("comp") == F.col("g_comp")).select("e", "comp", "g")
        small = sets.groupBy(F.col("g").alias("s_g")).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") <= BLOCK)
        whole = sets.join(small, F.col("g") == F.col("s_g"), "left_semi")
        rows = whole.select(F.lit(False).alias("by_key"), F.col("g").alias("key"), F.lit(0).alias("low"), F.lit(0).alias("high"), "e", "comp", F.lit(0).alias("part"))
        large = sets.join(small, F.col("g") == F.col("s_g"), "left_anti").select(F.col("e").alias("l_e"))
        rest = dealt.join(edges.select("key").distinct(), "key", "left_semi").join(large, F.col("e") == F.col("l_e"), "left_semi")
        rest = rest.select(F.lit(True).alias("by_key"), "key", "low", "high", "e", "comp", "part")

        met = rows.unionByName(rest).join(features.withColumnRenamed("e", "f_e"), F.col("e") == F.col("f_e")).drop("f_e")
        found = written(met.groupBy("by_key", "key", "low", "high").applyInArrow(_across(self.scheme), "a long, b long"), "sets-links")
        discard(edges, groups)
        release(self.spark)
        return found

    def placed(self) -> DataFrame:
        """``rows`` of sets in links, with ``least``, the least doc_id of their class (LAST: none)."""
        found = components(self.links())
        joined = self.sets.select("e", "h1", "h2", "d").join(found, F.col("e") == F.col("node"), "left").select("h1", "h2", "d", F.coalesce("comp", "e").alias("comp"))
        least = joined.groupBy(F.col("comp").alias("l_comp")).agg(F.min("d").alias("least"))
        classes = joined.join(least, F.col("comp") == F.col("l_comp")).select(F.col("h1").alias("c_h1"), F.col("h2").alias("c_h2"), "comp", "least")
        same = (F.col("h1") == F.col("c_h1")) & (F.col("h2") == F.col("c_h2")) & (F.col("n") > 0)
        return self.rows.drop("sign").join(classes, same, "left").drop("c_h1", "c_h2")


def grouped(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (the smallest doc_id that links reach, itself included; null ids come last)."""
    rows = SetLinks(docs, scheme).placed()
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.nullif(F.coalesce("least", "d"), F.lit(LAST)).alias("component_id"))


def first_of_each(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """The rows of ``docs``, all columns, without those whose class has an earlier row; of rows equal in doc_id and text one stays."""
    rows = SetLinks(docs, scheme).placed().where("comp is not null").select("comp", F.struct("d", "tie").alias("row"))
    first = rows.groupBy(F.col("comp").alias("f_comp")).agg(F.min("row").alias("first"))
    later = rows.join(first, F.col("comp") == F.col("f_comp")).where("row != first").select("row.*").distinct()
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(F.struct("*").alias("whole"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("d"), F.xxhash64(text).alias("tie"))
    return keyed.join(later, ["d", "tie"], "left_anti").dropDuplicates(["d", "tie"]).select("whole.*")
