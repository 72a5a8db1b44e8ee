"""WARC archives as a Python data source, and deduplicated archiving of pages.

``spark.read.format("warc")`` plans a partition per archive file; large files are cut by bytes where
an offset index lies beside them (``<archive>.idx``: the records' places, as this writer leaves it).
Predicates on headers are pushed down. A record's header is parsed first; if a predicate rules it
out, or the read wants no payloads, the rest of it is passed over: an uncompressed record by a
seek, a compressed one with an index too, for only the first bytes of its gzip member are inflated.
A compressed file of others, without an index, has to be inflated to find where records end.

Options of a read: ``path`` (a file or folder of any file system that pyarrow opens), ``payload``
("false" leaves payloads null), ``split_bytes``. Options of a write: ``path``, ``compression``
("gzip", a member a record, or "none").
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage

from lumenfold.llm.common import join_small, materialize, or_empty, read_table, shared_dir

SCHEMA = "record_id string, record_type string, target_uri string, date string, payload_digest string, refers_to string, content_length long, payload_length long, payload binary"
#: Column -> WARC header.
HEADERS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To", "content_length": "Content-Length"}
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
BATCH_BYTES = 8 << 20
#: Bytes of an indexed archive in one partition, about; bytes inflated at a time while a header is read.
SPLIT_BYTES, HEADER_BYTES = 128 << 20, 256


def file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def header_bytes(first: str, fields: dict[str, object]) -> bytes:
    """CR and LF can't be in a field: they are written percent-encoded."""
    clean = lambda v: str(v).replace("\r", "%0D").replace("\n", "%0A")
    return "".join([first, "\r\n", *(f"{k}: {clean(v)}\r\n" for k, v in fields.items() if v is not None), "\r\n"]).encode()


def record_bytes(row: dict) -> bytes:
    """One record; ``payload`` None makes a revisit, whose HTTP header still states the length."""
    http = header_bytes("HTTP/1.1 200 OK", {"Content-Type": "text/html; charset=utf-8", "Content-Length": row["payload_length"]})
    revisit = row["record_type"] == "revisit"
    block = http if revisit else http + (row["payload"] or b"")
    fields = {"WARC-Type": row["record_type"], "WARC-Record-ID": row["record_id"], "WARC-Date": row["date"] or DATE, "WARC-Target-URI": row["target_uri"], "WARC-Payload-Digest": row["payload_digest"]}
    if revisit:
        fields |= {"WARC-Profile": IDENTICAL, "WARC-Refers-To": row["refers_to"]}
    fields |= {"Content-Type": "application/http;msgtype=response", "Content-Length": len(block)}
    return header_bytes("WARC/1.1", fields) + block + b"\r\n\r\n"


def read_header(f) -> tuple[str, dict[str, str]] | None:
    """The first line and the fields of a header block; None at the end of the file."""
    first = f.readline()
    while first in (b"\r\n", b"\n"):
        first = f.readline()
    if not first:
        return None
    fields = {}
    while (line := f.readline()) not in (b"\r\n", b"\n", b""):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        fields[name.strip().lower()] = value.strip()
    return first.decode("utf-8", "replace").strip(), fields


def read_record(f, wanted, payloads: bool, skip) -> dict | bool:
    """The next record, True for one whose header ``wanted`` refuses, False at the end. ``skip(n)`` passes over n bytes of ``f``."""
    head = read_header(f)
    if head is None:
        return False
    if not head[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {head[0][:80]!r}")
    fields = head[1]
    row: dict = {column: fields.get(name.lower()) for column, name in HEADERS.items()}
    row["content_length"] = length = int(row["content_length"] or 0)
    if not wanted(row):
        skip(length)
        return True
    row |= {"payload": None, "payload_length": None}
    if not fields.get("content-type", "").startswith("application/http"):
        row["payload_length"] = length
        if payloads:
            row["payload"] = f.read(length)
        else:
            skip(length)
        return row
    http = io.BytesIO()
    left = length
    while left > 0:  # the HTTP header only
        line = f.readline(left)
        left -= len(line)
        http.write(line)
        if line in (b"\r\n", b"\n", b""):
            break
    http.seek(0)
    said = read_header(http)
    row["payload_length"] = int(said[1].get("content-length", left)) if said else left
    if row["record_type"] == "revisit" or not payloads:
        skip(left)
    else:
        row["payload"] = f.read(left)
    return row


class Member:
    """A gzip member of known length, inflated only as far as it is read."""

    def __init__(self, raw, length: int) -> None:  # noqa: ANN001
        self.raw, self.left, self.z, self.held, self.inflated = raw, length, zlib.decompressobj(31), b"", 0

    def _more(self, n: int) -> bool:
        data = self.z.unconsumed_tail
        if not data and self.left > 0:
            data = self.raw.read(min(self.left, 1 << 16))
            self.left -= len(data)
        out = self.z.decompress(data, n)
        self.inflated += len(out)
        self.held += out
        return bool(data)

    def _take(self, n: int) -> bytes:
        out, self.held = self.held[:n], self.held[n:]
        return out

    def readline(self, limit: int = -1) -> bytes:
        while (at := self.held.find(b"\n")) < 0 and not 0 <= limit <= len(self.held) and self._more(HEADER_BYTES):
            continue
        n = at + 1 if at >= 0 else len(self.held)
        return self._take(min(n, limit) if limit >= 0 else n)

    def read(self, n: int) -> bytes:
        while len(self.held) < n and self._more(n - len(self.held)):
            continue
        return self._take(n)


@dataclass
class ArchivePart(InputPartition):
    """The records of a file that begin within its bytes lo to hi; the whole file if it has no index."""

    path: str
    indexed: bool
    lo: int
    hi: int


class WarcReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.payloads, self.filters = options["path"], options.get("payload", "true").lower() != "false", []
        self.split_bytes = int(options.get("split_bytes", SPLIT_BYTES))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Takes comparisons of header columns with literals; hands back the rest."""
        for f in filters:
            if isinstance(f, EqualTo | In | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual | IsNotNull) and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, path = file_system(self.path)
        info = system.get_file_info(path)
        if info.type == fs.FileType.File:
            found = [info, *(x for x in [system.get_file_info(f"{path}.idx")] if x.is_file)]
        else:
            found = system.get_file_info(fs.FileSelector(path, recursive=True))
        indexes = {x.path for x in found if x.is_file and x.path.endswith(".idx")}
        parts = []
        for x in sorted(found, key=lambda x: x.path):
            if x.is_file and x.base_name.endswith((".warc", ".warc.gz")):
                indexed = f"{x.path}.idx" in indexes
                size = max(1, x.size)
                step = self.split_bytes if indexed else size
                parts += [ArchivePart(x.path, indexed, lo, min(lo + step, size)) for lo in range(0, size, step)]
        return parts

    def wanted(self, row: dict) -> bool:
        for f in self.filters:
            v = row[f.attribute[0]]
            if v is None:
                return False
            ok = (
                True if isinstance(f, IsNotNull) else v in f.value if isinstance(f, In) else v == f.value if isinstance(f, EqualTo)
                else v > f.value if isinstance(f, GreaterThan) else v >= f.value if isinstance(f, GreaterThanOrEqual) else v < f.value if isinstance(f, LessThan) else v <= f.value
            )
            if not ok:
                return False
        return True

    def records(self, partition: ArchivePart) -> Iterator[dict]:
        system, _ = file_system(self.path)
        zipped = partition.path.endswith(".gz")
        with system.open_input_file(partition.path) as raw:
            if partition.indexed:
                with system.open_input_file(f"{partition.path}.idx") as f:
                    edges = np.frombuffer(f.read(), dtype="<i8")  # one file's records and its end
                data = io.BufferedReader(raw, 1 << 16)
                first, last = np.searchsorted(edges[:-1], [partition.lo, partition.hi])
                for a, b in zip(edges[first:last].tolist(), edges[first + 1 : last + 1].tolist(), strict=True):
                    data.seek(a)
                    row = read_record(Member(data, b - a) if zipped else data, self.wanted, self.payloads, lambda n: None)
                    if isinstance(row, dict):
                        yield row
                return
            if zipped:
                f = io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 20)

                def skip(n: int) -> None:
                    while n > 0 and (got := len(f.read(min(n, 1 << 20)))):
                        n -= got
            else:
                f = io.BufferedReader(raw, 1 << 16)
                skip = lambda n: f.seek(n, io.SEEK_CUR)
            while (row := read_record(f, self.wanted, self.payloads, skip)) is not False:
                if row is not True:
                    yield row

    def read(self, partition: ArchivePart) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema()
        rows, size = [], 0
        for row in self.records(partition):
            rows.append(row)
            size += 300 + len(row["payload"] or b"")
            if size > BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


def arrow_schema() -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in SCHEMA.split(", "))])


@dataclass
class Written(WriterCommitMessage):
    name: str
    records: int


class WarcWriter(DataSourceArrowWriter):
    """One archive per task, with its offset index, under names that readers look for only once the job commits.

    An overwrite removes what was there before only then. What failed attempts of the job left is
    removed at its end, whichever way it ends.
    """

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.gzip, self.overwrite = options["path"], options.get("compression", "gzip") == "gzip", overwrite
        self.job, self.end = uuid.uuid4().hex, ".warc.gz" if self.gzip else ".warc"
        system, path = file_system(self.path)
        system.create_dir(path, recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, folder = file_system(self.path)
        name, edges = f"{self.job}-{uuid.uuid4().hex}", [0]
        with system.open_output_stream(f"{folder}/{name}.part", compression=None) as f:
            for batch in iterator:
                for i in range(batch.num_rows):
                    data = record_bytes({c: batch.column(k)[i].as_py() for k, c in enumerate(batch.schema.names)})
                    data = gzip.compress(data, 4, mtime=0) if self.gzip else data
                    f.write(data)
                    edges.append(edges[-1] + len(data))
        with system.open_output_stream(f"{folder}/{name}.idx.part", compression=None) as f:
            f.write(np.array(edges, dtype="<i8").tobytes())
        return Written(name, len(edges) - 1)

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = file_system(self.path)
        old = self._files(lambda name: name.endswith((".warc", ".warc.gz", ".idx"))) if self.overwrite else []
        for m in messages:
            if m is not None:  # the index first: an archive that can be seen has its index
                system.move(f"{folder}/{m.name}.idx.part", f"{folder}/{m.name}{self.end}.idx")
                system.move(f"{folder}/{m.name}.part", f"{folder}/{m.name}{self.end}")
        for path in old:
            system.delete_file(path)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = file_system(self.path)
        for path in self._files(lambda name: name.startswith(self.job) and name.endswith(".part")):
            system.delete_file(path)

    def _files(self, wanted) -> list[str]:  # noqa: ANN001
        from pyarrow import fs

        system, folder = file_system(self.path)
        return [x.path for x in system.get_file_info(fs.FileSelector(folder)) if x.is_file and wanted(x.base_name)]


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:  # noqa: ANN001
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:  # noqa: ANN001
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def with_digest(pages: DataFrame, payloads: bool) -> DataFrame:
    """page_id, url, bytes, digest (and payload): the html in UTF-8, null as empty."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column(2).cast(pa.binary())
            lengths = pa.array([len(x.as_buffer()) for x in data], pa.int64())
            digest = pa.array([sha1_base32(x.as_buffer()) for x in data], pa.string())
            cols = [batch.column(0), batch.column(1), lengths, digest, *([data] if payloads else [])]
            yield pa.record_batch(cols, ["page_id", "url", "bytes", "digest", *(["payload"] if payloads else [])])

    columns = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), or_empty(F.col("html").cast("string")))
    return columns.mapInArrow(add, f"page_id long, url string, bytes long, digest string{', payload binary' if payloads else ''}")


def archive(pages: DataFrame, path: str, min_bytes: int = 0, compression: str = "gzip") -> None:
    """Write a record per page under ``path``.

    Among pages with equal payloads of at least ``min_bytes``, the one with the smallest page_id is
    a response and the others revisit it. Rows that repeat both page_id and payload are the same
    kind of record. A null page_id is never referred to and always a response. Payloads move only
    if there are more revisits than may be broadcast.
    """
    narrow = materialize(with_digest(pages, payloads=False).drop("url"), "digests")
    same = narrow.filter(F.col("bytes") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("_first"), F.max("page_id").alias("_last")).filter("_first < _last").drop("_last")
    revisits = materialize(narrow.join(same, "digest").filter("page_id <> _first").select("page_id", "digest", "_first").distinct(), "revisits")
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    r = join_small(with_digest(pages, payloads=True), revisits, ["page_id", "digest"], "left")
    again = F.col("_first").isNotNull()
    rows = r.select(
        urn(F.col("page_id")).alias("record_id"), F.when(again, "revisit").otherwise("response").alias("record_type"), F.col("url").alias("target_uri"), F.lit(DATE).alias("date"),
        F.concat(F.lit("sha1:"), "digest").alias("payload_digest"), F.when(again, urn(F.col("_first"))).alias("refers_to"), F.lit(None).cast("long").alias("content_length"),
        F.col("bytes").alias("payload_length"), F.when(~again, F.col("payload")).alias("payload"),
    )
    register(pages.sparkSession)
    rows.write.format("warc").mode("append").option("path", path).option("compression", compression).save()


def page_records(spark: SparkSession, path: str) -> DataFrame:
    """Per record, read back from the archives: the digest of a response is taken of what is there."""
    register(spark)
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    records = lambda payload: spark.read.format("warc").option("path", path).option("payload", payload).load()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = b.column(1)
            yield pa.record_batch([b.column(0), pa.array([len(x.as_buffer()) for x in data], pa.int64()), pa.array([sha1_base32(x.as_buffer()) for x in data], pa.string()), b.column(2), b.column(3)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    columns = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    full = records("true").filter("record_type = 'response'").select(number("record_id").alias("page_id"), "payload", "record_type", F.lit(None).cast("long").alias("refers_to")).mapInArrow(digest, columns)
    revisit = records("false").filter("record_type = 'revisit'").select(number("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"))
    return full.union(revisit)


def op10_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    archive(read_table(spark, sf_dir, "pages"), path)
    return page_records(spark, path)


_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(sha1(html), {5 * i + 1}, 5))::BIGINT >> {s}) & 31) + 1, 1)" for i in range(8) for s in (15, 10, 5, 0))
OP10_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, strlen(html) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f
"""
