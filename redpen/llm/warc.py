"""WARC archives written and read by Spark tasks, with a globally ordered capture index.

Every writing task makes archive files of gzip members and, for each, an index run sorted by
URL key and time.  The runs are merged by loser trees, as many at a time as ``FAN_IN``; in the
last pass each task merges one range of keys, reading only the row groups of each run
that may hold it.  Files get names of their own and are only listed once a task has ended, so
a task that runs again leaves files that nobody reads.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redpen.llm.common import shared_folder, written

#: An archive file is closed when it has this many bytes, and its index run with it.
FILE_BYTES = 64 << 20
#: Runs that one loser tree merges.
FAN_IN = 64
#: Rows of a row group of a run; a range task skips groups by their least and greatest keys.
GROUP_ROWS = 5000
#: Keys that the bounds of the ranges are taken from, for all runs together.
SAMPLE_KEYS = 10_000
#: Seconds since 1970 of the capture of page 0; page n is captured n seconds later.
FIRST_CAPTURE = 1_577_836_800

INDEX = pa.schema(
    [("url_key", pa.string()), ("captured", pa.int64()), ("record_id", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("digest", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]
)
INDEX_DDL = "url_key string, captured long, record_id string, url string, record_type string, digest string, file string, offset long, length long"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: str | None) -> str:
    """The host's labels from the last to the first, then path and query; "-" without a host."""
    try:
        parts = urlsplit((url or "").strip())
        host = parts.hostname or ""
    except ValueError:
        return "-"
    if not host:
        return "-"
    labels = host.removeprefix("www.").split(".")
    return ",".join(reversed(labels)) + ")" + (parts.path or "/").lower() + (f"?{parts.query.lower()}" if parts.query else "")


def _stamp(seconds: int) -> str:
    from datetime import datetime, timedelta

    return (datetime(1970, 1, 1) + timedelta(seconds=seconds)).strftime("%Y-%m-%dT%H:%M:%SZ")


def _record(record_id: str, url: str | None, captured: int, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One record as bytes.  A revisit keeps the HTTP head, whose Content-Length is that of the full payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to else head + payload
    fields = [("WARC-Type", "revisit" if refers_to else "response"), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", _stamp(captured))]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", url)))
    fields.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if refers_to:
        fields += [("WARC-Profile", REVISIT), ("WARC-Refers-To", f"<{refers_to}>")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Header fields of a record (lower-case names), with ``payload`` and ``payload_length``."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next((int(x.split(b":", 1)[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(payload))
    return fields | {"payload": payload, "payload_length": length}


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def _archived(folder: str):
    """Rows (record_id, url, captured, html, refers_to) to archive files; returns (run, rows, sample keys) of each file."""
    def run(batches):
        files, base = _file_system(folder)
        files.create_dir(base, recursive=True)
        name, out, at, entries = None, None, 0, []

        def closed() -> pa.RecordBatch:
            out.close()
            entries.sort(key=lambda e: (e[0], e[1], e[2]))
            table = pa.Table.from_pylist([dict(zip(INDEX.names, e, strict=True)) for e in entries], schema=INDEX)
            pq.write_table(table, f"{base}/{name}.run", filesystem=files, row_group_size=GROUP_ROWS, compression="zstd")
            keys = [entries[k][0] for k in range(0, len(entries), max(1, len(entries) // 32))]
            return pa.RecordBatch.from_arrays([pa.array([f"{name}.run"]), pa.array([len(entries)], pa.int64()), pa.array([keys])], ["run", "rows", "keys"])

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name, at, entries = uuid.uuid4().hex, 0, []
                    out = files.open_output_stream(f"{base}/{name}.warc.gz", compression=None)
                payload = (row["html"] or "").encode()
                digest = hashlib.sha1(payload).hexdigest()
                record = _record(row["record_id"], row["url"], row["captured"], payload, digest, row["refers_to"])
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = packer.compress(record) + packer.flush()
                out.write(member)
                entries.append((url_key(row["url"]), row["captured"], row["record_id"], row["url"], "revisit" if row["refers_to"] else "response", digest, f"{name}.warc.gz", at, len(member)))
                at += len(member)
                if at >= FILE_BYTES:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return run


class LoserTree:
    """Merges sorted iterators: each inner node keeps the loser of its match, so a new row meets log k others."""

    def __init__(self, sources: list[Iterator], key: Callable):
        self.sources, self.key = sources, key
        self.size = 1
        while self.size < len(sources):
            self.size *= 2
        self.rows = [next(s, None) for s in sources] + [None] * (self.size - len(sources))
        self.losers = [0] * self.size
        winners = [0] * self.size + list(range(self.size))
        for node in range(self.size - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._first(a, b) else (b, a)
        self.best = winners[1] if self.size > 1 else 0

    def _first(self, a: int, b: int) -> bool:
        if self.rows[a] is None or self.rows[b] is None:
            return self.rows[b] is None and (self.rows[a] is not None or a < b)
        return (self.key(self.rows[a]), a) < (self.key(self.rows[b]), b)

    def __iter__(self) -> Iterator:
        while (row := self.rows[self.best]) is not None:
            yield row
            at = self.best
            self.rows[at] = next(self.sources[at], None)
            node = (at + self.size) // 2
            while node:
                if self._first(self.losers[node], at):
                    self.losers[node], at = at, self.losers[node]
                node //= 2
            self.best = at


def _slice(files, path: str, low: str | None, high: str | None) -> Iterator[dict]:
    """Rows of a run with low <= url_key < high, group by group; None is open."""
    run = pq.ParquetFile(path, filesystem=files)
    column = run.schema_arrow.get_field_index("url_key")
    for g in range(run.metadata.num_row_groups):
        stats = run.metadata.row_group(g).column(column).statistics
        if stats is not None and stats.has_min_max and ((high is not None and stats.min >= high) or (low is not None and stats.max < low)):
            continue
        for row in run.read_row_group(g).to_pylist():
            if (low is None or row["url_key"] >= low) and (high is None or row["url_key"] < high):
                yield row


def _merged_rows(files, paths: list[str], low: str | None, high: str | None) -> Iterator[dict]:
    return iter(LoserTree([_slice(files, p, low, high) for p in paths], lambda r: (r["url_key"], r["captured"], r["record_id"])))


def _merge_groups(folder: str):
    """Groups of runs (list of names) to one longer run each."""
    def run(batches):
        files, base = _file_system(folder)
        for batch in batches:
            for names in batch.column(0).to_pylist():
                name, held = f"{uuid.uuid4().hex}.run", []
                with pq.ParquetWriter(f"{base}/{name}", INDEX, filesystem=files, compression="zstd") as writer:
                    for row in _merged_rows(files, [f"{base}/{n}" for n in names], None, None):
                        held.append(row)
                        if len(held) == GROUP_ROWS:
                            writer.write_table(pa.Table.from_pylist(held, schema=INDEX))
                            held = []
                    if held:
                        writer.write_table(pa.Table.from_pylist(held, schema=INDEX))
                yield pa.RecordBatch.from_arrays([pa.array([name])], ["run"])

    return run


def _merge_ranges(folder: str, runs: list[str]):
    """Ranges (number, low, high) to the ordered rows of all runs in them."""
    def run(batches):
        files, base = _file_system(folder)
        for batch in batches:
            for bounds in batch.to_pylist():
                held = []
                for row in _merged_rows(files, [f"{base}/{n}" for n in runs], bounds["low"], bounds["high"]):
                    held.append(row | {"part": bounds["part"]})
                    if len(held) == GROUP_ROWS:
                        yield _placed(held)
                        held = []
                if held:
                    yield _placed(held)

    return run


def _placed(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=INDEX.insert(0, pa.field("part", pa.int32())))


def write(pages: DataFrame, folder: str, least_bytes: int = 1000) -> DataFrame:
    """Archive ``pages`` (page_id, url, html) below ``folder`` and return the list of runs (run, rows, keys).

    Of pages with equal payloads of at least ``least_bytes`` bytes the one with the largest page_id is a
    response, and the others are revisits of it; smaller ones are all responses.  A null html is an empty
    payload, a null url gives the key "-", a null page_id comes before all others.  Rows equal in
    all three columns are written once each and, if large, all are responses where they have the largest id.
    """
    spark = pages.sparkSession
    text = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", text.alias("html"), F.xxhash64("url", "html").alias("row"))
    name = F.concat_ws(":", F.lit("urn:redpen:page"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.hex("row"))
    facts = rows.where(F.octet_length("html") >= least_bytes).select("page_id", name.alias("record_id"), F.sha2("html", 256).alias("payload"))
    owner = F.max(F.struct(F.coalesce("page_id", F.lit(-(1 << 63))).alias("id"), "record_id")).alias("owner")
    owners = facts.groupBy("payload").agg(owner, F.count(F.lit(1)).alias("n")).where("n > 1").withColumnRenamed("payload", "o_payload")
    again = facts.join(owners, F.col("payload") == F.col("o_payload")).where(F.coalesce("page_id", F.lit(-(1 << 63))) < F.col("owner.id"))
    again = again.select(F.col("record_id").alias("a_id"), F.col("owner.record_id").alias("refers_to")).distinct()
    captured = F.coalesce("page_id", F.lit(0)) % (1 << 33) + FIRST_CAPTURE
    out = rows.withColumn("record_id", name).join(again, F.col("record_id") == F.col("a_id"), "left")
    out = out.select("record_id", "url", captured.alias("captured"), "html", "refers_to")
    return written(out.mapInArrow(_archived(folder), "run string, rows long, keys array<string>"), "warc-runs")


def merged_index(spark: SparkSession, folder: str, runs: DataFrame, ranges: int | None = None) -> DataFrame:
    """The capture history: ``part`` and the index columns, ordered by URL key, time and record within a part, and parts by key.

    The driver holds names of runs and at most SAMPLE_KEYS keys, never the rows.
    """
    keys = runs.select(F.explode("keys").alias("key")).where("key is not null")
    sample = sorted(r["key"] for r in keys.orderBy(F.xxhash64("key"), "key").limit(SAMPLE_KEYS).collect())
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted({sample[len(sample) * k // ranges] for k in range(1, ranges)} if sample else set())
    names = [r["run"] for r in runs.select("run").toLocalIterator()]
    while len(names) > FAN_IN:
        groups = [(names[k : k + FAN_IN],) for k in range(0, len(names), FAN_IN)]
        longer = spark.createDataFrame(groups, "runs array<string>").repartition(len(groups)).mapInArrow(_merge_groups(folder), "run string")
        names = [r["run"] for r in written(longer, "warc-runs").toLocalIterator()]
    edges = [None, *bounds, None]
    parts = [(k, edges[k], edges[k + 1]) for k in range(len(edges) - 1)]
    table = spark.createDataFrame(parts, "part int, low string, high string").repartition(len(parts), "part")
    return written(table.mapInArrow(_merge_ranges(folder, names), f"part int, {INDEX_DDL}"), "warc-index")


def _read_at(folder: str):
    """Index rows in order of file and offset to the records read there."""
    def run(batches):
        files, base = _file_system(folder)
        name, source = None, None
        for batch in batches:
            out = []
            for file, offset, length in zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True):
                if file != name:
                    if source is not None:
                        source.close()
                    name, source = file, files.open_input_file(f"{base}/{file}")
                record = parse_record(zlib.decompress(source.read_at(length, offset), 31))
                kind, payload = record["warc-type"], record["payload"]
                refers = record.get("warc-refers-to")
                said = record["warc-payload-digest"].removeprefix("sha1:")
                digest = said if kind == "revisit" else hashlib.sha1(payload).hexdigest()
                if digest != said or (kind == "response" and len(payload) != record["payload_length"]):
                    raise ValueError(f"{file} at {offset}: payload and header differ")
                out.append((record["warc-record-id"].strip("<>"), record["payload_length"], digest, kind, refers and refers.strip("<>")))
            if out:
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["record_id", "payload_bytes", "payload_digest", "record_type", "refers_to_id"])

    return run


def read(index: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the records that ``index`` names, from the archives."""
    # files are read whole and in order; all rows of a file are at most FILE_BYTES of archive
    places = index.select("file", "offset", "length").repartition("file").sortWithinPartitions("file", "offset")
    rows = places.mapInArrow(_read_at(folder), "record_id string, payload_bytes long, payload_digest string, record_type string, refers_to_id string")

    def page(column: str):
        return F.get(F.split(column, ":"), F.lit(3)).try_cast("long")

    return rows.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to_id").alias("refers_to"))


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write archives and merged index, then read every record back."""
    spark = pages.sparkSession
    folder = folder or shared_folder(spark, "warc")
    return read(merged_index(spark, folder, write(pages, folder)), folder)


def op2_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from redpen.llm.common import table

    return round_trip(table(spark, sf_dir, "pages"))
