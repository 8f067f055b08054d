"""Token-id output: Parquet files of token lists, read back in parts.

Documents are range-partitioned by doc_id before they are encoded, so every file holds a
range in order.  Ids are a list column with dictionary encoding (delta encoding where a
dictionary does not fit), the other columns are delta-encoded, row groups and pages have set
sizes and carry page indexes: a reader of the metadata columns touches no ids, and a
reader of a doc_id range only its row groups and pages.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from redpen.llm.common import of_worker, shared_folder

SCHEMA = "doc_id long, part int, local_start long, n_tokens int, ids array<int>"
#: A cache of a worker's encoded words keeps the quarter met most often when it has this many entries.
CACHED_WORDS = 300_000
#: Texts are encoded in pieces of about this many bytes.
PIECE_BYTES = 1 << 20


@dataclass(frozen=True)
class Format:
    row_group_bytes: int = 32 << 20
    page_bytes: int = 256 << 10
    page_rows: int = 2000
    compression: str = "zstd"

    def options(self) -> dict[str, str]:
        options = {
            "parquet.writer.version": "v2",
            "parquet.enable.dictionary": "true",
            "parquet.block.size": str(self.row_group_bytes),
            "parquet.page.size": str(self.page_bytes),
            "parquet.page.row.count.limit": str(self.page_rows),
            "compression": self.compression,
        }
        return options | {f"parquet.enable.dictionary#{c}": "false" for c in ("doc_id", "local_start", "n_tokens")}


def _class_of(kinds: str) -> str:
    return "".join(chr(c) for c in range(0xA1, 0x180) if unicodedata.category(chr(c))[0] == kinds)


class Encoder:
    """Encodes with a tokenizer whose pieces never span white space: words met before come from a cache.

    Splitting into words is done here only for texts in Latin letters, whose lower-casing and
    normal form are the same everywhere; all other texts go whole through the library.
    """

    plain = re.compile("[\t\n\v\f\r\x20-\x7e\xa1-įı-ſ]*")
    piece = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{_class_of('L')}]+|[0-9{_class_of('N')}]|[^\\sa-z{_class_of('L')}0-9{_class_of('N')}]+|\n")

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        self.library, self.end_id = Tokenizer.from_file(path), end_id
        ends = [i for t, i in self.library.get_vocab(with_added_tokens=False).items() if t.endswith("</w>")]
        self.is_end = np.zeros(self.library.get_vocab_size() + 1, bool)
        self.is_end[ends] = True
        self.special = re.compile("|".join(re.escape(t.content) for t in self.library.get_added_tokens_decoder().values()) or "(?!)")
        self.clear()

    def clear(self) -> None:
        self.words, self.pieces = _Known([self.end_id]), _Known([])
        # blanks at the ends of a text leave words without characters
        self.words.put([""], np.zeros(0, np.int32), np.zeros(1, np.int64))

    def _learn(self, new: set[str]) -> None:
        """Encode words not met before, by way of their distinct pieces."""
        new = list(new)
        found = self.piece.findall("\n".join(new) + "\n")
        missing = list(set(found).difference(self.pieces.codes))
        if missing:
            ids = np.array(self.library.encode_batch_fast(["\n".join(missing)], add_special_tokens=False)[0].ids, np.int32)
            stops = np.flatnonzero(self.is_end[ids]) + 1
            if len(stops) != len(missing):
                # a piece whose ids do not end where a word ends: one by one
                parts = [e.ids for e in self.library.encode_batch_fast(missing, add_special_tokens=False)]
                ids, stops = np.array([i for p in parts for i in p], np.int32), np.cumsum([len(p) for p in parts])
            self.pieces.put(missing, ids, stops)
        codes = np.fromiter(map(self.pieces.codes.__getitem__, found), np.int64, len(found))
        ids, stops = self.pieces.take(codes)
        # a line feed, which has no ids, ends each word
        self.words.put(new, ids, stops[codes == self.pieces.codes["\n"]])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and for each text the position after its end."""
        for known in (self.words, self.pieces):
            if len(known.codes) > CACHED_WORDS:
                known.trim(CACHED_WORDS // 4)
        odd = [n for n, text in enumerate(texts) if not self.plain.fullmatch(text) or self.special.search(text)]
        plain = pa.array(texts, pa.large_string())
        if odd:
            known = np.ones(len(texts), bool)
            known[odd] = False
            plain = pc.if_else(pa.array(known), plain, "")
        own = pc.ascii_split_whitespace(pc.utf8_lower(plain))
        words = own.flatten().dictionary_encode()
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        if new := set(distinct).difference(self.words.codes):
            self._learn(new)
        codes = np.fromiter(map(self.words.codes.__getitem__, distinct), np.int64, len(distinct))[words.indices.to_numpy()]
        # the end id stands behind the words of each text
        stops_of_texts = np.cumsum(pc.list_value_length(own).to_numpy())
        ids, stops = self.words.take(np.insert(codes, stops_of_texts, 0))
        ends = stops[stops_of_texts + np.arange(len(texts))]
        if odd:
            whole = self.library.encode_batch_fast([texts[n] for n in odd], add_special_tokens=False)
            at = ends[odd] - 1
            ids = np.insert(ids, np.repeat(at, [len(e.ids) for e in whole]), np.array([i for e in whole for i in e.ids], np.int32))
            more = np.zeros(len(texts), np.int64)
            more[odd] = [len(e.ids) for e in whole]
            ends = ends + np.cumsum(more)
        return ids, ends


class _Known:
    """Strings with their ids, in flat arrays; the string of code 0 is a line feed."""

    def __init__(self, ids_of_line_feed: list[int]):
        self.codes = {"\n": 0}
        self.flat, self.starts, self.lens = array("i", ids_of_line_feed), array("q", [0]), array("q", [len(ids_of_line_feed)])
        self.met = np.zeros(1, np.int64)

    def put(self, new: list[str], ids: np.ndarray, stops: np.ndarray) -> None:
        """``new`` get codes in order; their ids follow each other in ``ids`` and end at ``stops``."""
        begin = len(self.starts)
        starts = np.concatenate([[0], stops[:-1]]).astype(np.int64)
        self.codes.update(zip(new, range(begin, begin + len(new)), strict=True))
        self.starts.frombytes((starts + len(self.flat)).tobytes())
        self.lens.frombytes((stops - starts).astype(np.int64).tobytes())
        self.flat.frombytes(ids.astype(np.int32).tobytes())

    def take(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of ``codes`` in a row, and where those of each end."""
        times = np.bincount(codes, minlength=len(self.met))
        times[: len(self.met)] += self.met
        self.met = times
        return self._ids(codes)

    def trim(self, most: int) -> None:
        """Keep the ``most`` strings met most often since the last time, and the first two."""
        times = np.zeros(len(self.starts), np.int64)
        times[: len(self.met)] = self.met
        times[:2] = times.max() + 1
        kept = np.sort(np.argsort(-times, kind="stable")[:most])
        names, (ids, stops) = list(self.codes), self._ids(kept)
        starts = np.concatenate([[0], stops[:-1]]).astype(np.int64)
        self.codes = {names[old]: new for new, old in enumerate(kept.tolist())}
        self.flat, self.starts, self.lens = array("i", ids.tobytes()), array("q", starts.tobytes()), array("q", (stops - starts).tobytes())
        self.met = np.zeros(1, np.int64)

    def _ids(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lens = np.frombuffer(self.lens, np.int64)[codes]
        stops = np.cumsum(lens)
        at = np.repeat(np.frombuffer(self.starts, np.int64)[codes] - (stops - lens), lens)
        return np.frombuffer(self.flat, np.int32)[at + np.arange(len(at))] if len(self.flat) else np.zeros(0, np.int32), stops


def _encoder(path: str, end_id: int) -> Encoder:
    return of_worker(("encoder", path, end_id), lambda: Encoder(path, end_id))


def write(docs: DataFrame, tokenizer: str, end_id: int, path: str, form: Format = Format()) -> None:
    """Encode ``docs`` (doc_id, text) into token files below ``path``, in ascending doc_id order.

    Null ids come first.  Rows of one doc_id follow each other, ordered by text.  A null or
    empty text is the end id alone.  An empty table writes files without rows.
    """
    def encoded(batches):
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, part, at = _encoder(tokenizer, end_id), TaskContext.get().partitionId(), 0
        for batch in batches:
            upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            begin = 0
            while begin < len(upto):
                done = upto[begin - 1] if begin else 0
                stop = max(begin + 1, int(np.searchsorted(upto, done + PIECE_BYTES, "right")))
                ids, ends = encoder.encode([t or "" for t in batch.column(1).slice(begin, stop - begin).to_pylist()])
                offsets = np.concatenate([[0], ends]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(begin, stop - begin),
                        pa.array(np.full(stop - begin, part, np.int32)),
                        pa.array(at + offsets[:-1].astype(np.int64)),
                        pa.array(np.diff(offsets)),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)),
                    ],
                    ["doc_id", "part", "local_start", "n_tokens", "ids"],
                )
                at, begin = at + int(offsets[-1]), stop

    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(encoded, SCHEMA).write.options(**form.options()).parquet(path)


def read(spark, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def located(rows: DataFrame, files: DataFrame) -> DataFrame:
    """``rows`` (part, local_start, ...) with ``start``, the number of ids in all documents before.

    The offsets come from the metadata columns of ``files``; there is one for each file.
    """
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("part").alias("o_part"), F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    joined = rows.join(offsets, F.col("part") == F.col("o_part"))
    return joined.withColumn("start", F.col("offset") + F.col("local_start")).drop("o_part", "offset")


def digests(files: DataFrame) -> DataFrame:
    """doc_id, part, local_start, n_tokens (counted from the ids) and ids_crc32 of each document in ``files``."""
    def summed(batches):
        for batch in batches:
            ids = batch.column(3)
            offsets = ids.offsets.to_numpy()
            data = memoryview(np.ascontiguousarray(ids.values.to_numpy().astype("<u4", copy=False)))
            crcs = [zlib.crc32(data[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            columns = [batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crcs, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "local_start", "n_tokens", "ids_crc32"])

    schema = "doc_id long, part int, local_start long, n_tokens long, ids_crc32 long"
    return files.select("doc_id", "part", "local_start", "ids").mapInArrow(summed, schema)


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2, path: str | None = None, form: Format = Format()) -> DataFrame:
    """Write the token files, read them back, and return doc_id, start, n_tokens and ids_crc32 of each document in them."""
    spark = docs.sparkSession
    path = path or shared_folder(spark, "tokens")
    write(docs, tokenizer, end_id, path, form)
    files = read(spark, path)
    return located(digests(files), files)


def op8_query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from redpen.llm.common import table

    out = round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32")
