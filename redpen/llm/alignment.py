"""Where the tokens of two tokenizers end together, and which tokens of the two belong to each other.

Texts are cut where neither tokenizer joins anything, pieces not met before go through the libraries,
and the byte ends of both token lists are met by galloping search.  Ends that both have slice the
lists into groups; differences of ranks give the tokens of one that overlap a token of the other.
Two tokens that end together are one the tail of the other, so the pairs that can be linked are
numbered from the vocabularies alone, and their counts have a size that no corpus changes.
"""

from __future__ import annotations

import hashlib
import os
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redpen.llm.common import of_worker, written
from redpen.llm.gallop import common as common_places
from redpen.llm.gallop import places

#: Texts are aligned in stretches of about this many bytes; a longer text is one stretch.
PIECE_BYTES = 2 << 20
#: A worker forgets the pieces it has met when there are this many, or this many bytes of them.
KNOWN_PIECES, KNOWN_BYTES = 600_000, 16 << 20

#: White space beyond ASCII, next to which blanks do not always part tokens, and the blank of the second vocabulary.
_ODD = r"[\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{2581}]"
_BLANK = "\u2581"
_SOLID = np.zeros(256, bool)
_SOLID[0x21:0x7F] = _SOLID[0x80:] = True
_GAP = np.zeros(256, bool)
_GAP[[0x20, 0x0A]] = True


def _byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: itself if it shows, else the next from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


class _Lists:
    """Lists of ids in one flat array, numbered as they come."""

    def __init__(self):
        self.flat, self.starts, self.lens = array("i"), array("q"), array("q")

    def add(self, lists: list) -> None:
        lens = np.fromiter(map(len, lists), np.int64, len(lists))
        self.starts.frombytes((len(self.flat) + np.cumsum(lens) - lens).tobytes())
        self.lens.frombytes(lens.tobytes())
        for x in lists:
            self.flat.extend(x)

    def take(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists of ``codes`` in a row, and the length of each."""
        lens = np.frombuffer(self.lens, np.int64)[codes]
        ends = np.cumsum(lens)
        at = np.repeat(np.frombuffer(self.starts, np.int64)[codes] - (ends - lens), lens)
        return np.frombuffer(self.flat, np.int32)[at + np.arange(len(at))] if len(self.flat) else np.zeros(0, np.int32), lens


@dataclass
class Aligned:
    """Token lists of some texts in a row: ``a_first[i]`` to ``a_first[i + 1]`` are those of text i; ends are byte offsets of the whole."""

    a: np.ndarray
    b: np.ndarray
    a_first: np.ndarray
    b_first: np.ndarray
    a_ends: np.ndarray
    b_ends: np.ndarray
    #: Of each group the place of its last token in ``a`` and in ``b``.
    a_last: np.ndarray
    b_last: np.ndarray

    def overlaps(self) -> tuple[np.ndarray, np.ndarray]:
        """For each token of ``a`` the first token of ``b`` that shares bytes with it, and the place after the last one."""
        below = places(self.a_ends, self.b_ends)
        joint = np.zeros(len(below), np.int64)
        joint[self.a_last] = 1
        return np.concatenate([[0], (below + joint)[:-1]])[: len(below)], below + 1


class Aligner:
    """``a_path``: a byte-level vocabulary file of the tokenizers library.  ``b_path``: a sentencepiece model with byte fallback."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = _byte_letters()
        special = set(self.a.get_added_tokens_decoder())
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            if i not in special:
                self.a_bytes[i] = bytes(letters[c] for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_is_byte = np.array([self.b.is_byte(i) for i in range(len(pieces))])
        self.b_bytes = [
            b"" if self.b.is_control(i) or self.b.is_unknown(i) else bytes([int(p[3:5], 16)]) if self.b_is_byte[i] else p.replace(_BLANK, " ").encode()
            for i, p in enumerate(pieces)
        ]
        self.a_len, self.b_len = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        # blanks and line feeds part the pieces of the second vocabulary only if none has one after another sign
        self.cuts = not any(_BLANK in p.lstrip(_BLANK) or "\n" in p for p in pieces)
        self._number_pairs()
        self._name_tokens()
        self.clear()

    def _number_pairs(self) -> None:
        """``pair_b``: of each pair of tokens that can end together the second; ``slots``: where to find a pair's number.

        The place is told by the longer token and the length of the other, and for a single byte by its kind.
        """
        self.a_base = np.cumsum(2 * (self.a_len + 1)) - 2 * (self.a_len + 1)
        first = int(self.a_base[-1] + 2 * (self.a_len[-1] + 1))
        self.b_base = first + np.cumsum(self.b_len + 1) - (self.b_len + 1)
        self.slots = np.full(int(self.b_base[-1] + self.b_len[-1] + 1), -1, np.int32)
        whole = {x: i for i, x in enumerate(self.b_bytes) if x and not self.b_is_byte[i]}
        single = {x: i for i, x in enumerate(self.b_bytes) if x and self.b_is_byte[i]}
        own = {x: i for i, x in enumerate(self.a_bytes) if x}
        pair_a, pair_b = [], []

        def add(slot: int, i: int, j: int) -> None:
            self.slots[slot] = len(pair_a)
            pair_a.append(i)
            pair_b.append(j)

        for x, i in own.items():
            for n in range(1, len(x) + 1):
                for kind, known in ((0, whole), (1, single)):
                    if (j := known.get(x[-n:])) is not None:
                        add(int(self.a_base[i]) + 2 * n + kind, i, j)
        for x, j in whole.items():
            for n in range(1, len(x)):
                if (i := own.get(x[-n:])) is not None:
                    add(int(self.b_base[j]) + n, i, j)
        self.pair_a, self.pair_b = np.array(pair_a, np.int32), np.array(pair_b, np.int32)

    def _name_tokens(self) -> None:
        """Every id as decimal digits with each of the signs that can follow it."""
        a, b = ([str(i) for i in range(len(side))] for side in (self.a_bytes, self.b_bytes))
        self.names = pa.array([i + e for side, ends in ((a, ",|"), (b, (",", ";", ""))) for e in ends for i in side])

    def clear(self) -> None:
        self.codes: dict[bytes, int] = {}
        self.known_bytes = 0
        self.lists, self.bad = (_Lists(), _Lists()), array("b")

    def _learn(self, new: list[bytes]) -> None:
        """Encode pieces not met before.  Each begins with a blank or a line feed."""
        texts = [x.decode() for x in new]
        a = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        # the library puts a blank before what it encodes: the piece's own, or one to be taken off
        b = self.b.encode([x[1:] if x[0] == " " and len(x) > 1 else x for x in texts], num_threads=1)
        b = [ids if x[0] == " " and len(x) > 1 else ids[1:] if x[0] != " " else self.b.encode("\n")[:1] for x, ids in zip(texts, b, strict=True)]
        for side, lists in zip((a, b), self.lists, strict=True):
            lists.add(side)
        self.bad.extend(b"".join(map(self.a_bytes.__getitem__, i)) != x or b"".join(map(self.b_bytes.__getitem__, j)) != x for x, i, j in zip(new, a, b, strict=True))
        self.codes.update(zip(new, range(len(self.codes), len(self.codes) + len(new)), strict=True))
        self.known_bytes += sum(map(len, new))

    def _pieces(self, data: np.ndarray, offsets: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each piece its number, and of each text the first of its pieces.  Texts marked ``whole`` are one piece."""
        begin = np.zeros(len(data), bool)
        begin[1:] = _GAP[data[1:]] & _SOLID[data[:-1]] & self.cuts
        for i in np.flatnonzero(whole):
            begin[offsets[i] : offsets[i + 1]] = False
        begin[offsets[:-1]] = True
        starts = np.flatnonzero(begin)
        bounds = np.append(starts, len(data)).astype(np.int64)
        found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
        distinct = found.dictionary.to_pylist()
        if len(self.codes) > KNOWN_PIECES or self.known_bytes > KNOWN_BYTES:
            self.clear()
        if new := [x for x in distinct if x not in self.codes]:
            self._learn(new)
        codes = np.fromiter(map(self.codes.__getitem__, distinct), np.int64, len(distinct))
        return codes[found.indices.to_numpy()], np.searchsorted(starts, offsets)

    def align(self, texts: pa.Array) -> Aligned:
        """Align ``texts`` (large strings, none null).  An empty text, and one that a tokenizer does not give back byte by byte, has no tokens."""
        if not len(texts):
            nothing = np.zeros(0, np.int64)
            return Aligned(nothing, nothing, np.zeros(1, np.int64), np.zeros(1, np.int64), *[nothing] * 4)
        blank = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string()))
        offsets = np.frombuffer(blank.buffers()[1], np.int64)[blank.offset : blank.offset + len(blank) + 1]
        data = np.frombuffer(blank.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        whole = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        codes, first = self._pieces(data, offsets, whole)
        bad = np.frombuffer(self.bad, np.int8)[codes]
        if len(bad) and (again := np.logical_or.reduceat(bad, first[:-1]) & ~whole).any():
            # a piece that does not come back: its text is taken in one
            codes, first = self._pieces(data, offsets, whole | again)
            bad = np.frombuffer(self.bad, np.int8)[codes]
        live = ~np.logical_or.reduceat(bad, first[:-1]).astype(bool) & (np.diff(offsets) > 1)
        owner = np.repeat(np.arange(len(texts)), np.diff(first))
        chosen = live[owner]
        codes, owner = codes[chosen], owner[chosen]
        ids, firsts, ends = [], [], []
        for lists, lens in zip(self.lists, (self.a_len, self.b_len), strict=True):
            own, counts = lists.take(codes)
            ids.append(own)
            each = np.bincount(owner, counts, len(texts)).astype(np.int64) if len(owner) else np.zeros(len(texts), np.int64)
            firsts.append(np.append(0, np.cumsum(each)))
            ends.append(np.cumsum(lens[own]))
        return Aligned(*ids, *firsts, *ends, *common_places(*ends))

    def links(self, x: Aligned) -> np.ndarray:
        """The number of the pair of tokens that end each group."""
        i, j = x.a[x.a_last], x.b[x.b_last]
        m, n = self.a_len[i], self.b_len[j]
        return self.slots[np.where(n <= m, self.a_base[i] + 2 * n + self.b_is_byte[j], self.b_base[j] + m)]

    def written_groups(self, x: Aligned) -> tuple[memoryview, np.ndarray]:
        """The groups of all texts as ``a1,a2|b1;a3|b2,b3`` in one buffer, and where those of each text begin."""
        a_end, b_end = np.zeros(len(x.a), np.int64), np.zeros(len(x.b), np.int64)
        a_end[x.a_last] = b_end[x.b_last] = 1
        a_group, b_group = np.cumsum(a_end) - a_end, np.cumsum(b_end) - b_end
        index = np.empty(len(x.a) + len(x.b), np.int64)
        index[np.arange(len(x.a)) + np.append(0, x.b_last + 1)[a_group]] = x.a + len(self.a_bytes) * a_end
        b_end[x.b_first[1:][np.diff(x.b_first) > 0] - 1] = 2
        index[np.arange(len(x.b)) + (x.a_last + 1)[b_group]] = x.b + 2 * len(self.a_bytes) + len(self.b_bytes) * b_end
        out = self.names.take(pa.array(index))
        offsets = np.frombuffer(out.buffers()[1], np.int32)[out.offset : out.offset + len(out) + 1]
        return memoryview(out.buffers()[2] or b""), offsets[x.a_first + x.b_first].astype(np.int64) if len(out) else np.zeros(len(x.a_first), np.int64)


def aligner(a_path: str, b_path: str) -> Aligner:
    return of_worker(("aligner", a_path, b_path), lambda: Aligner(a_path, b_path))


def _stretches(batches, most: int = PIECE_BYTES):
    """(ids, texts) of Arrow batches (doc_id, text) in stretches of bounded bytes; null texts are empty."""
    for batch in batches:
        text = batch.column(1).cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        at = 0
        while at < len(text):
            to = min(max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1), len(text))
            yield batch.column(0).slice(at, to - at), text.slice(at, to - at)
            at = to


def alignments(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Per row: doc_id, the ids of both tokenizers, ``a_stops`` and ``b_stops`` (where each group ends in them), and
    ``overlap_from`` and ``overlap_to``, for each first token the range of second tokens that share bytes with it.

    Null and empty texts, and texts that a tokenizer does not give back, have empty lists.
    """
    def run(batches):
        own = aligner(a_path, b_path)
        for ids, texts in _stretches(batches):
            x = own.align(texts)
            low, high = x.overlaps()
            groups = np.searchsorted(x.a_last, x.a_first)
            b_base = np.repeat(x.b_first[:-1], np.diff(x.a_first))
            lists = [(x.a, x.a_first), (x.b, x.b_first)]
            lists += [(last + 1 - np.repeat(first[:-1], np.diff(groups)), groups) for last, first in ((x.a_last, x.a_first), (x.b_last, x.b_first))]
            lists += [(low - b_base, x.a_first), (high - b_base, x.a_first)]
            yield pa.RecordBatch.from_arrays(
                [ids, *(pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values.astype(np.int32))) for values, first in lists)],
                ["doc_id", "a_ids", "b_ids", "a_stops", "b_stops", "overlap_from", "overlap_to"],
            )

    lists = ", ".join(f"{k} array<int>" for k in ("a_ids", "b_ids", "a_stops", "b_stops", "overlap_from", "overlap_to"))
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, {lists}")


def _digested(a_path: str, b_path: str):
    """Per row the sizes and the digest of its groups, and the pair numbers of its links."""
    def run(batches):
        own = aligner(a_path, b_path)
        for ids, texts in _stretches(batches):
            x = own.align(texts)
            text, at = own.written_groups(x)
            groups = np.searchsorted(x.a_last, x.a_first)
            links = own.links(x).astype("<i4")
            stops = at.tolist()
            digests = [hashlib.sha256(text[i:j]).hexdigest() if j > i else "" for i, j in zip(stops[:-1], stops[1:], strict=True)]
            raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(4 * groups.astype(np.int64)), pa.py_buffer(links)])
            sizes = [pa.array(np.diff(first).astype(np.int64)) for first in (x.a_first, x.b_first, groups)]
            yield pa.RecordBatch.from_arrays([ids, *sizes, pa.array(digests, pa.string()), raw.cast(pa.binary())], ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links"])

    return run


def _summed(a_path: str, b_path: str):
    """(links) to (pair, n), added up inside the task: at most one row for each pair of the vocabularies."""
    def run(batches):
        sums = np.zeros(len(aligner(a_path, b_path).pair_b), np.int64)
        for batch in batches:
            for links in _numbers(batch.column(0)):
                sums += np.bincount(links, minlength=len(sums))
        pair = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(sums[pair])], ["pair", "n"])

    return run


def _numbers(column: pa.Array):
    """The numbers in a binary column, some rows at a time."""
    for at in range(0, len(column), 1024):
        yield np.frombuffer(b"".join(column.slice(at, 1024).to_pylist()), "<i4")


def _weighed(totals, best):
    """(doc_id, ..., links) to the sums of each row over its links."""
    def run(batches):
        counts, leads = np.frombuffer(totals.value, np.int64), np.frombuffer(best.value, bool)
        for batch in batches:
            links = batch.column(batch.num_columns - 1)
            n_best, weight = np.zeros(len(links), np.int64), np.zeros(len(links), np.int64)
            for i, raw in enumerate(links.to_pylist()):
                own = np.frombuffer(raw, "<i4")
                n_best[i], weight[i] = leads[own].sum(), counts[own].sum()
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n_best), pa.array(weight)], [*batch.schema.names[:-1], "n_best", "count_sum"])

    return run


def linked(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A link is a pair of token occurrences that end together: each group has one.  ``n_best``: links whose
    pair is the commonest of its second token in all documents, ties included; ``count_sum``: how often the pairs of the row's links
    are linked in all documents.  Null and empty texts, and texts that a tokenizer does not give back, have zeros
    and an empty digest.  Rows are rows: repeated ids and texts count each.  Other columns of ``docs`` are ignored.
    """
    spark = docs.sparkSession
    columns = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string"
    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_digested(a_path, b_path), f"{columns}, links binary")
    rows = written(rows, "alignment")
    sums = rows.select("links").mapInArrow(_summed(a_path, b_path), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    # one number for each pair that the two vocabularies allow, whatever the corpus
    pair_b = aligner(a_path, b_path).pair_b
    totals = np.zeros(len(pair_b), np.int64)
    for batch in sums.toArrow().to_batches():
        totals[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    most = np.zeros(pair_b.max(initial=0) + 1, np.int64)
    np.maximum.at(most, pair_b, totals)
    held = [spark.sparkContext.broadcast(x.tobytes()) for x in (totals, totals == most[pair_b])]
    out = rows.mapInArrow(_weighed(*held), f"{columns}, n_best long, count_sum long")
    return out.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256")


def op11_query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from redpen.llm.common import table

    return linked(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
