"""WARC archives: a writer and a Spark data source.

Records are gzip members of their own.  The writer notes a member's length in
the gzip extra field "sl", so the reader can step over a member of which it has
inflated the first bytes only.  Payloads that are equal are stored once: the
others become revisit records that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs, parquet
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull)

from larder.llm.files import create, locate, open_read
from larder.llm.tables import pick

LEVEL = 4
FIRST_BYTES = 4096  # of a member, read for its headers
BATCH_BYTES = 4 << 20
PARTITION_BYTES = 128 << 20
LIST = "files.list"
RESPONSE, REVISIT = "response", "revisit"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"  # the pages have no clock
SCHEMA = ("record_type string, record_id string, target_uri string, refers_to string, "
          "payload_digest string, payload_bytes long, payload binary, found_digest string")


# Writing ---------------------------------------------------------------------

def member(data: bytes) -> bytes:
    """One gzip member with its length in the extra field "sl"."""
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    size = 10 + 2 + 12 + len(body) + 8
    extra = b"" if max(size, len(data)) >> 32 else struct.pack(
        "<H2sHII", 12, b"sl", 8, size, len(data))
    return (b"\x1f\x8b\x08" + (b"\x04" if extra else b"\x00") + bytes(6) + extra + body
            + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF))


def record_uri(page_id: int | None) -> str:
    return f"urn:page:{'' if page_id is None else page_id}"


def header_value(text: str) -> str:
    """``text`` without line ends, which would end a header."""
    return "".join(c if c.isprintable() and c != " " else "".join(
        f"%{b:02X}" for b in c.encode()) for c in text)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str,
           refers_to: int | None, revisit: bool) -> bytes:
    http = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            b"Content-Length: %d\r\n\r\n" % len(payload))
    block = http if revisit else http + payload
    kind = REVISIT if revisit else RESPONSE
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_uri(page_id)}>",
             f"WARC-Target-URI: {header_value(url or '') or record_uri(page_id)}",
             f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}",
             "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    if revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}",
                  f"WARC-Refers-To: <{record_uri(refers_to)}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Write one record per row of ``pages`` (page_id, url, html) below ``folder``.

    Returns the list of files: path, n_bytes and n_records.  It is also kept in the
    folder, and the source reads by it, so that what a lost or repeated task left
    behind does not count.  The payload is the
    html in UTF-8; null counts as empty.  Of equal payloads of ``min_bytes`` or
    more the one with the largest page_id is a response and the others are
    revisits of it; smaller payloads are all responses.  Rows that repeat the
    largest id are responses each; a null id is never the largest.  A null url
    becomes the record's own URI.  An empty table makes no record.
    """
    rows = pick(pages, page_id="long", url="string", html="string").withColumn(
        "html", F.coalesce("html", F.lit("")))
    rows = rows.withColumn("sha1", F.sha1("html")).withColumn("n", F.octet_length("html"))
    largest = rows.where(F.col("n") >= min_bytes).groupBy("sha1", "n").agg(
        F.max("page_id").alias("kept_id"))
    rows = rows.join(largest, ["sha1", "n"], "left").withColumn(
        "revisit", F.col("kept_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept_id")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, stream = create(folder, f"pages-{TaskContext.get().partitionId():06d}", ".warc.gz")
        stream.write(member(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:archive>\r\n"
                            b"WARC-Date: %s\r\nContent-Length: 0\r\n\r\n\r\n\r\n" % DATE.encode()))
        n = 0
        for batch in batches:
            for i in range(len(batch)):
                row = {k: batch.column(k)[i].as_py() for k in (
                    "page_id", "url", "html", "sha1", "kept_id", "revisit")}
                stream.write(member(record(
                    row["page_id"], row["url"], row["html"].encode(), base32(row["sha1"]),
                    row["kept_id"], row["revisit"])))
                n += 1
        size = stream.tell()
        stream.close()
        yield pa.RecordBatch.from_pydict({
            "path": [path], "n_bytes": pa.array([size], pa.int64()),
            "n_records": pa.array([n], pa.int64())})

    listed = rows.select("page_id", "url", "html", "sha1", "kept_id", "revisit").mapInArrow(
        write, "path string, n_bytes long, n_records long")
    listed.write.parquet(f"{folder}/{LIST}")
    return pages.sparkSession.read.schema(listed.schema).parquet(f"{folder}/{LIST}")


# Reading ---------------------------------------------------------------------

def parse_headers(raw: bytes) -> dict[str, str]:
    """Header lines of a record by lower-case name."""
    found = {}
    for line in raw.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            found[name.strip().lower()] = value.strip()
    return found


def skip_length(raw: bytes) -> int:
    """A gzip member's length from its extra field "sl", or 0."""
    if len(raw) < 24 or not raw[3] & 4:
        return 0
    size, at = struct.unpack_from("<H", raw, 10)[0], 12
    while at + 4 <= min(len(raw), 12 + size):
        name, length = struct.unpack_from("<2sH", raw, at)
        if name == b"sl" and length == 8:
            return struct.unpack_from("<I", raw, at + 4)[0]
        at += 4 + length
    return 0


def zipped_records(stream, size: int, wanted) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of the ``wanted`` records; others are inflated no further than
    their headers where their length is known."""
    at = 0
    while at < size:
        stream.seek(at)
        raw = stream.read(FIRST_BYTES)
        length, inflate, text = skip_length(raw), zlib.decompressobj(31), b""
        used = len(raw)
        text = inflate.decompress(raw, FIRST_BYTES)
        while b"\r\n\r\n" not in text and not inflate.eof:
            more = inflate.unconsumed_tail
            if not more:
                more = stream.read(FIRST_BYTES)
                used += len(more)
                if not more:
                    raise ValueError(f"a record at byte {at} is cut off")
            text += inflate.decompress(more, FIRST_BYTES)
        head, _, block = text.partition(b"\r\n\r\n")
        headers = parse_headers(head)
        take = wanted(headers)
        if take or not length:
            parts = [block] if take else []
            while not inflate.eof:
                more = inflate.unconsumed_tail or stream.read(1 << 16)
                if not inflate.unconsumed_tail:
                    used += len(more)
                if not more:
                    raise ValueError(f"a record at byte {at} is cut off")
                part = inflate.decompress(more, 1 << 20)
                if take:
                    parts.append(part)
            if take:
                yield headers, b"".join(parts)[:int(headers.get("content-length", 0))]
        at += length or used - len(inflate.unused_data)


def plain_records(stream, size: int, wanted) -> Iterator[tuple[dict[str, str], bytes]]:
    """The same of an archive without compression: unwanted blocks are not even read."""
    at = 0
    while at < size:
        stream.seek(at)
        text = b""
        while b"\r\n\r\n" not in text:
            more = stream.read(FIRST_BYTES)
            if not more:
                if text.strip():
                    raise ValueError(f"a record at byte {at} is cut off")
                return
            text += more
        head = text.partition(b"\r\n\r\n")[0]
        headers = parse_headers(head)
        begin, length = at + len(head) + 4, int(headers.get("content-length", 0))
        if wanted(headers):
            stream.seek(begin)
            yield headers, stream.read(length)
        at = begin + length + 4


# The columns that filters may name, and the headers they are read from.
HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id",
           "target_uri": "warc-target-uri", "refers_to": "warc-refers-to",
           "payload_digest": "warc-payload-digest"}


def header_column(headers: dict[str, str], column: str) -> str | None:
    value = headers.get(HEADERS[column])
    if value is None or column == "payload_digest":
        return value and value.partition(":")[2]
    return value.strip("<>")


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(paths)
        self.paths = paths


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]
        self.bytes = int(options.get("partition_bytes", PARTITION_BYTES))
        self.payload = options.get("payload", "true").lower() == "true"
        self.wants: list[tuple[str, frozenset]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes equality and membership on header columns; they decide on headers alone."""
        for one in filters:
            if isinstance(one, EqualTo) and one.attribute[0] in HEADERS:
                self.wants.append((one.attribute[0], frozenset([one.value])))
            elif isinstance(one, In) and one.attribute[0] in HEADERS:
                self.wants.append((one.attribute[0], frozenset(one.value)))
            elif not (isinstance(one, IsNotNull) and one.attribute[0] == "record_type"):
                yield one

    def partitions(self) -> list[Files]:
        """Files in ascending order of name, packed up to ``partition_bytes``."""
        packed, room = [], 0
        for path, size in sorted(self.files()):
            if room < size or not packed:
                packed.append([])
                room = self.bytes
            packed[-1].append(path)
            room -= size
        return [Files(paths) for paths in packed or [[]]]

    def files(self) -> list[tuple[str, int]]:
        """The files that the writer listed, or else all archives of the folder."""
        system, path = locate(self.folder)
        if system.get_file_info(f"{path}/{LIST}").type == fs.FileType.Directory:
            listed = parquet.read_table(f"{path}/{LIST}", filesystem=system)
            return list(zip(listed["path"].to_pylist(), listed["n_bytes"].to_pylist()))
        infos = system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
        prefix = self.folder[:len(self.folder) - len(path)] if self.folder.endswith(path) else ""
        return [(prefix + i.path, i.size) for i in infos
                if i.is_file and i.path.endswith((".warc", ".warc.gz"))]

    def wanted(self, headers: dict[str, str]) -> bool:
        return headers.get("warc-type") != "warcinfo" and all(
            header_column(headers, column) in values for column, values in self.wants)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.binary() if n == "payload" else pa.int64()
                             if n == "payload_bytes" else pa.string())
                            for n in (c.split()[0] for c in SCHEMA.split(", "))])
        rows, held = [], 0
        for path in partition.paths:
            with open_read(path) as stream:
                records = zipped_records if path.endswith(".gz") else plain_records
                for headers, block in records(stream, stream.size(), self.wanted):
                    rows.append(self.row(headers, block))
                    held += len(block)
                    if held > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    def row(self, headers: dict[str, str], block: bytes) -> dict:
        row = {column: header_column(headers, column) for column in HEADERS}
        http, _, body = block.partition(b"\r\n\r\n")
        if not headers.get("content-type", "").startswith("application/http"):
            http, body = b"", block
        if row["record_type"] == REVISIT:
            length = parse_headers(http).get("content-length")
            return row | {"payload_bytes": int(length) if length else None}
        return row | {"payload_bytes": len(body), "payload": body if self.payload else None,
                      "found_digest": base64.b32encode(hashlib.sha1(body).digest()).decode()}


class WarcSource(DataSource):
    """``spark.read.format("warc").load(folder)``: the records of .warc and .warc.gz files.

    Options: ``partition_bytes`` (small files are packed up to it) and ``payload``
    (false leaves the payload column null).  A payload of a revisit is null, its
    payload_bytes those of the payload referred to.  ``found_digest`` is the SHA-1
    of the payload as read.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)


def read_archives(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """The records below ``folder``; filters on header columns reach the reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").options(**options).load(folder)
