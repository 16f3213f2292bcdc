"""WARC archives as a Python data source (operator 5): ``spark.read.format("warc")`` and
``df.write.format("warc")``.

Writing: every record is a gzip member of its own; a task writes files of about
``roll_bytes`` under names of its own, each with an index of record offsets
(64-bit, little-endian, one more than records). Only files of tasks that succeeded are
listed in the commit file, so retried tasks leave at most unused files.

Reading: each file is planned as ranges of records of about ``split_bytes`` by its
index, or as one range without an index. A record's header is inflated and parsed
first. Predicates on ``record_type``, ``record_id``, ``target_uri``,
``payload_digest`` and ``refers_to`` are pushed down and judged on the header; a
record that fails is left there, and the index gives the next record without
inflating the rest. Payloads are decoded only with the option ``payload`` (and
checked against their digest with ``verify``).

Nulls and odd input: a null payload is empty; a null uri has no target header;
control characters and ``%`` in header values are percent-encoded and decoded again;
repeated rows are separate records; an empty table makes an archive without records.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull,
    StringStartsWith, WriterCommitMessage,
)
from pyspark.sql.types import StructType

from vocalframe.llm.files import open_fs, read_bytes, write_bytes

SCHEMA = ("record_type string, record_id string, target_uri string, date string, payload_digest string, refers_to string, "
          "payload_bytes bigint, payload binary")
#: Columns judged on the header, and their WARC fields.
FIELDS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri",
          "date": "warc-date", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
END = b"\r\n\r\n"


#: Our writer's mark of a record whose header values are percent-escaped; other archives' values are read as they are.
ESCAPES = "WARC-Field-Escapes"


def encoded(value: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f%]", lambda m: f"%{ord(m[0]):02X}", value)


def decoded(value: str) -> str:
    return re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), value)


def record(kind: str, record_id: str, uri: str | None, date: str, payload: bytes, refers_to: str | None) -> bytes:
    """One record: a response holds the payload, a revisit only its HTTP header."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{encoded(record_id)}>", f"WARC-Date: {date}",
            f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
            f"Content-Length: {len(block)}"]
    if uri is not None:
        head.append(f"WARC-Target-URI: {encoded(uri)}")
    if refers_to is not None:
        head.append(f"WARC-Refers-To: <{encoded(refers_to)}>")
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    if any(encoded(v) != v for v in (record_id, uri or "", refers_to or "")):
        head.append(f"{ESCAPES}: percent")
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + END + block + END) + z.flush()


@dataclass
class Done(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Columns: record_type, record_id, target_uri, date, payload, refers_to."""

    def __init__(self, folder: str, roll_bytes: int):
        self.folder, self.roll_bytes = folder, roll_bytes

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Done:
        files, out, offsets = [], None, [0]

        def close() -> None:
            if out is not None:
                out.close()
                write_bytes(f"{self.folder}/{files[-1]}.idx", np.array(offsets, "<i8").tobytes())

        for batch in iterator:
            cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for k in range(batch.num_rows):
                row = {n: c[k].as_py() for n, c in cols.items()}
                if out is None or offsets[-1] >= self.roll_bytes:
                    close()
                    files.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    f, path = open_fs(f"{self.folder}/{files[-1]}")
                    f.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    out, offsets = f.open_output_stream(path, compression=None), [0]
                data = record(row["record_type"], row["record_id"] or "", row["target_uri"], row["date"], row["payload"] or b"", row["refers_to"])
                out.write(data)
                offsets.append(offsets[-1] + len(data))
        close()
        return Done(files)

    def commit(self, messages: list) -> None:
        files = sorted(x for m in messages if m is not None for x in m.files)
        write_bytes(f"{self.folder}/_committed-{uuid.uuid4().hex}.json", json.dumps(files).encode())

    def abort(self, messages: list) -> None:
        for name in (x for m in messages if m is not None for x in m.files):
            f, path = open_fs(f"{self.folder}/{name}")
            for p in (path, path + ".idx"):
                if f.get_file_info(p).type == fs.FileType.File:
                    f.delete_file(p)


@dataclass
class Range(InputPartition):
    name: str
    offsets: np.ndarray | None      # of the records and the end, or None: read on to the end


def inflate(data: memoryview | bytes) -> tuple[zlib._Decompress, bytes]:
    """A started decompressor and the bytes up to the end of the WARC header."""
    z = zlib.decompressobj(31)
    head = z.decompress(data, 1024)
    while END not in head and z.unconsumed_tail:
        head += z.decompress(z.unconsumed_tail, 4096)
    return z, head


def parse_header(head: bytes) -> dict[str, str]:
    lines = head.split(END, 1)[0].decode("utf-8", "replace").split("\r\n")
    pairs = (line.split(":", 1) for line in lines[1:] if ":" in line)
    out = {k.strip().lower(): v.strip() for k, v in pairs}
    plain = decoded if ESCAPES.lower() in out else str
    return {k: plain(v.strip("<>")) if k in FIELDS.values() else v for k, v in out.items()}


class WarcReader(DataSourceReader):
    def __init__(self, folder: str, payload: bool, verify: bool, split_bytes: int):
        self.folder, self.payload, self.verify, self.split_bytes = folder, payload, verify, split_bytes
        self.wanted: list[Filter] = []

    def pushFilters(self, filters: list[Filter]):
        for x in filters:
            if isinstance(x, (EqualTo, In, StringStartsWith, IsNotNull)) and len(x.attribute) == 1 and x.attribute[0] in FIELDS:
                self.wanted.append(x)
            else:
                yield x

    def _fits(self, head: dict[str, str]) -> bool:
        for x in self.wanted:
            value = self._value(head, x.attribute[0])
            if value is None or isinstance(x, EqualTo) and value != x.value or isinstance(x, In) and value not in x.value \
                    or isinstance(x, StringStartsWith) and not value.startswith(x.value):
                return False
        return True

    @staticmethod
    def _value(head: dict[str, str], column: str) -> str | None:
        value = head.get(FIELDS[column])
        return value.removeprefix("sha1:") if value and column == "payload_digest" else value

    def partitions(self) -> Sequence[InputPartition]:
        f, path = open_fs(self.folder)
        names = [x.base_name for x in f.get_file_info(fs.FileSelector(path, recursive=False))]
        commits = [n for n in names if n.startswith("_committed-")]
        files = sorted({x for n in commits for x in json.loads(read_bytes(f"{self.folder}/{n}"))}) if commits else \
            sorted(n for n in names if n.endswith(".warc.gz"))
        out: list[InputPartition] = []
        for name in files:
            if name + ".idx" not in names:
                out.append(Range(name, None))
                continue
            offsets = np.frombuffer(read_bytes(f"{self.folder}/{name}.idx"), "<i8")
            cuts = np.unique(np.searchsorted(offsets, np.arange(0, offsets[-1] + self.split_bytes, self.split_bytes)).clip(0, len(offsets) - 1))
            out.extend(Range(name, offsets[a:b + 1]) for a, b in zip(cuts[:-1], cuts[1:]))
        return out or [Range("", None)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for head, rest in self._records(partition):
            rows.append(self._row(head, rest))
            if len(rows) >= 200:
                yield self._batch(rows)
                rows = []
        if rows:
            yield self._batch(rows)

    def _records(self, p: Range) -> Iterator[tuple[dict[str, str], tuple]]:
        if not p.name:
            return
        f, path = open_fs(f"{self.folder}/{p.name}")
        with f.open_input_file(path) as src:
            if p.offsets is None:
                yield from self._scan(src)
                return
            for a, b in zip(p.offsets[:-1].tolist(), p.offsets[1:].tolist()):
                src.seek(a)
                z, head = inflate(src.read(min(b - a, 4096)))
                if END not in head and b - a > 4096:
                    src.seek(a)
                    z, head = inflate(src.read(b - a))
                    rest = b""
                else:
                    rest = None
                fields = parse_header(head)
                if self._fits(fields):
                    if rest is None and b - a > 4096:
                        src.seek(a + 4096)
                        rest = src.read(b - a - 4096)
                    yield fields, (z, head, rest or b"")

    def _scan(self, src) -> Iterator[tuple[dict[str, str], tuple]]:
        """Without an index every member has to be inflated to find the next."""
        data = src.read(1 << 20)
        while data:
            z, body = zlib.decompressobj(31), b""
            while not z.eof:
                body += z.decompress(data)
                data = z.unused_data if z.eof else src.read(1 << 20)
                if not data and not z.eof:
                    raise ValueError("a record ends early")
            data = data or src.read(1 << 20)
            fields = parse_header(body)
            if self._fits(fields):
                yield fields, (None, body, b"")

    def _row(self, head: dict[str, str], rest: tuple) -> tuple:
        z, body, more = rest
        if z is not None:
            whole = self.payload or self.verify
            start = len(body.split(END, 1)[0]) + len(END)
            want = start + int(head.get("content-length", 0))
            if not whole:
                want = min(want, start + 2048)           # the HTTP header is enough
            parts, size, feed = [body], len(body), z.unconsumed_tail + more
            while size < want and feed and not z.eof:
                parts.append(z.decompress(feed, want - size))
                size, feed = size + len(parts[-1]), z.unconsumed_tail
            body = b"".join(parts)
        block = body.split(END, 1)[1]
        block = block[:int(head.get("content-length", len(block)))]
        http, _, payload = block.partition(END)
        said = re.search(rb"(?im)^content-length:\s*(\d+)", http)
        n = int(said[1]) if said else len(payload)
        digest = self._value(head, "payload_digest")
        kind = head.get("warc-type")
        if self.verify and kind == "response" and digest:
            if len(payload) != n or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                raise ValueError(f"record {head.get('warc-record-id')} doesn't match its digest")
        return (*[self._value(head, c) for c in FIELDS], n, payload if self.payload and kind != "revisit" else None)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        names = [*FIELDS, "payload_bytes", "payload"]
        kinds = [pa.string()] * len(FIELDS) + [pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def _flag(self, name: str) -> bool:
        return str(self.options.get(name, "false")).lower() == "true"

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(self.options["path"].rstrip("/"), self._flag("payload"), self._flag("verify"),
                          int(self.options.get("split_bytes", 32 << 20)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options["path"].rstrip("/"), int(self.options.get("roll_bytes", 256 << 20)))


def register(spark: SparkSession) -> None:
    """Make the format known to the session, with predicate pushdown for Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def revisits(pages: DataFrame, page_id: str, payload: str, min_bytes: int = 0) -> DataFrame:
    """(rid, digest, refers_to): rows whose payload another row with a larger id has, too.

    The largest id per digest is a partial maximum, and only ids and digests are
    shuffled; a payload that a third of all rows share is one row of the right side."""
    p = pages.select(F.col(page_id).alias("rid"), F.sha1(payload).alias("digest"), F.octet_length(payload).alias("n"))
    p = p.where(F.col("n") >= min_bytes).select("rid", "digest")
    first = p.groupBy("digest").agg(F.max("rid").alias("refers_to"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    again = p.join(first, "digest").where("refers_to is not null and (rid is null or rid < refers_to)")
    return again.select("rid", F.col("digest").alias("rdigest"), "refers_to").distinct()


def archive(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html",
            min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write a record per row: a response, or a revisit of the row with the largest id and an equal payload."""
    spark = pages.sparkSession
    register(spark)
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).alias("pid"), F.col(url).alias("target_uri"), body.alias("payload"))
    again = revisits(rows, "pid", "payload", min_bytes)
    j = rows.withColumn("digest", F.sha1("payload")).join(
        again, F.col("pid").eqNullSafe(F.col("rid")) & (F.col("digest") == F.col("rdigest")), "left")
    (j.select(F.when(F.col("refers_to").isNull(), "response").otherwise("revisit").alias("record_type"),
              urn(F.col("pid")).alias("record_id"), "target_uri", F.lit(date).alias("date"), "payload",
              urn(F.col("refers_to")).alias("refers_to"))
     .write.format("warc").mode("append").save(folder))


def urn(c: Column) -> Column:
    return F.concat(F.lit("urn:page:"), c.cast("string"))


def page_of(c: Column) -> Column:
    return F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1).try_cast("bigint")


def read_archive(spark: SparkSession, folder: str, payload: bool = False, verify: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", payload).option("verify", verify).load(folder)
