"""WARC archives: a Python data source that reads and writes them.

Reading: each file is a partition.  Record headers are parsed first; filters
on header columns are pushed into the reader, and the block of a record that
they reject, or whose payload the schema leaves out, is skipped undecoded.

Writing: records are built by DataFrame functions; each is compressed as a gzip
member of its own, whose header states its lengths (the extra field "sl"), so
that a reader jumps over what it doesn't want without inflating it.  Tasks
write beside the archive; what they report is moved there when all are done, so
that lost or repeated tasks leave nothing behind.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .common import cut, scratch

#: Columns from record headers, with the headers that hold them.
HEADERS = {
    "record_type": "warc-type",
    "record_id": "warc-record-id",
    "target_uri": "warc-target-uri",
    "date": "warc-date",
    "content_type": "content-type",
    "payload_digest": "warc-payload-digest",
    "refers_to": "warc-refers-to",
}
NUMBERS = {"content_length": "content-length", "payload_length": "warc-payload-length"}
SCHEMA = ", ".join([*(f"{c} string" for c in HEADERS), *(f"{c} bigint" for c in NUMBERS), "payload binary"])
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
BATCH_BYTES = 8 << 20
#: Compressed bytes after which a task begins another file, as a file is what one task reads.
FILE_BYTES = 256 << 20
#: Repeated pages up to which their marks are sent to every task, and pages stay where they are; about 100 bytes each.
MARKS = 200_000
#: Start of a gzip member with the extra field that states its compressed and its full length.
MEMBER = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<H", 8)


class File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class WarcReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType) -> None:
        self.path, self.schema = path, schema
        self.wanted: list[tuple[str, frozenset]] = []

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                values = [f.value] if isinstance(f, EqualTo) else f.value
                self.wanted.append((HEADERS[f.attribute[0]], frozenset(values)))
            else:
                yield f

    def partitions(self) -> list[File]:
        store, at = fs.FileSystem.from_uri(self.path)
        if store.get_file_info(at).type == fs.FileType.NotFound:
            return [File("")]
        found = store.get_file_info(fs.FileSelector(at, recursive=True)) if store.get_file_info(at).type == fs.FileType.Directory else [store.get_file_info(at)]
        prefix = self.path.split("://")[0] + "://" if "://" in self.path else ""
        host = self.path.removeprefix(prefix).split("/")[0] if prefix and prefix != "file://" else ""
        return [File(f"{prefix}{host}{f.path}") for f in sorted(found, key=lambda f: -(f.size or 0)) if f.is_file and not f.base_name.startswith(("_", "."))] or [File("")]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        names = self.schema.names
        kinds = {**{c: pa.string() for c in HEADERS}, **{c: pa.int64() for c in NUMBERS}, "payload": pa.binary()}
        layout = pa.schema([(c, kinds[c]) for c in names])
        rows: list[dict] = []
        held = 0
        for headers, payload in records(partition.path, self.wanted, "payload" in names):
            row = {c: headers.get(h) for c, h in HEADERS.items()} | {c: int(headers[h]) if h in headers else None for c, h in NUMBERS.items()}
            rows.append(row | {"payload": payload})
            held += 400 + len(payload or b"")
            if held > BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, layout)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, layout)


def records(path: str, wanted: list[tuple[str, frozenset]], with_payload: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Headers (names in lower case) and payload of the records that are wanted.

    The payload of an HTTP message is what follows its headers; a revisit has
    none.  Header names repeat at most once in a record that this module
    reads; the last counts.
    """
    store, at = fs.FileSystem.from_uri(path)
    with store.open_input_file(at) as raw:
        file = Stream(raw)
        while line := file.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"no WARC record where one should begin, in {path}")
            headers: dict[str, str] = {}
            last = ""
            while line := file.readline().rstrip(b"\r\n"):
                if line[:1] in b" \t" and last:
                    headers[last] += " " + line.decode("utf-8", "replace").strip()
                    continue
                name, _, value = line.decode("utf-8", "replace").partition(":")
                last = name.strip().lower()
                headers[last] = value.strip()
            length = int(headers.get("content-length", "0"))
            if not all(headers.get(h) in values for h, values in wanted):
                file.skip(length)
            elif not with_payload or headers.get("warc-type") == "revisit":
                file.skip(length)
                yield headers, None
            else:
                block = file.read(length)
                if headers.get("content-type", "").startswith("application/http"):
                    block = block.partition(b"\r\n\r\n")[2]
                yield headers, block


class Stream:
    """The bytes of a file, plain or of any number of gzip members, in order."""

    CHUNK = 1 << 16

    def __init__(self, raw: pa.NativeFile) -> None:
        self.raw, self.held, self.at = raw, b"", 0
        start = raw.read(2)
        raw.seek(0)
        self.gzip = start == b"\x1f\x8b"
        self.inflate, self.left = None, b""  # of the member that is open; compressed bytes read ahead
        self.end = self.full = 0  # of a member that states its lengths: where it ends in the file, and its bytes
        self.given = 0  # bytes of the member that have been inflated

    def more(self) -> bool:
        """Gets bytes behind those held; whether there were any."""
        got = self.inflated() if self.gzip else self.raw.read(self.CHUNK)
        self.held, self.at = self.held[self.at :] + got, 0
        return bool(got)

    def inflated(self) -> bytes:
        while True:
            if self.inflate is None:
                while len(self.left) < len(MEMBER) + 8 and (got := self.raw.read(self.CHUNK)):
                    self.left += got
                if not self.left:
                    return b""
                self.inflate, self.end, self.given = zlib.decompressobj(31), 0, 0
                if self.left.startswith(MEMBER):
                    size, self.full = struct.unpack_from("<II", self.left, len(MEMBER))
                    self.end = self.raw.tell() - len(self.left) + size if size else 0
            if not self.left:
                self.left = self.raw.read(self.CHUNK)
                if not self.left:
                    raise EOFError("a gzip member breaks off")
            out = self.inflate.decompress(self.left, self.CHUNK)
            self.left = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
            self.given += len(out)
            if self.inflate.eof:
                self.inflate = None
            if out:
                return out

    def readline(self) -> bytes:
        looked = self.at
        while (found := self.held.find(b"\n", looked)) < 0:
            looked = len(self.held) - self.at
            if not self.more():
                found = len(self.held) - 1
                break
        line = self.held[self.at : found + 1]
        self.at = found + 1
        return line

    def read(self, length: int) -> bytes:
        parts = []
        while length > 0 and (self.at < len(self.held) or self.more()):
            part = self.held[self.at : self.at + length]
            self.at += len(part)
            length -= len(part)
            parts.append(part)
        return b"".join(parts)

    def skip(self, length: int) -> None:
        """Leaves out ``length`` bytes; where the member has nothing else but line breaks, without inflating them."""
        ahead = len(self.held) - self.at
        if self.inflate is not None and self.end and length > ahead and self.given + length - ahead + 4 >= self.full:
            self.raw.seek(self.end)
            self.held, self.at, self.left, self.inflate = b"", 0, b"", None
            return
        while length > 0 and (got := len(self.read(min(length, self.CHUNK)))):
            length -= got


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Writes the records of a column called record, a gzip member each."""

    def __init__(self, path: str) -> None:
        self.path, self.beside = path, f"{path}/_temporary/{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, at = fs.FileSystem.from_uri(self.beside)
        store.create_dir(at, recursive=True)
        names: list[str] = []
        out = None
        try:
            for batch in iterator:
                for record in batch.column("record"):
                    if out is None or out.tell() > FILE_BYTES:
                        if out is not None:
                            out.close()
                        names.append(f"{uuid.uuid4().hex}.warc.gz")
                        out = store.open_output_stream(f"{at}/{names[-1]}", compression=None)
                    out.write(member(record.as_py().encode() + b"\r\n\r\n"))
        finally:
            if out is not None:
                out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        store, at = fs.FileSystem.from_uri(self.path)
        _, beside = fs.FileSystem.from_uri(self.beside)
        store.create_dir(at, recursive=True)
        for k, name in enumerate(n for m in messages if m for n in m.names):
            store.move(f"{beside}/{name}", f"{at}/part-{k:05d}-{name}")
        self.clear(store, at)

    def abort(self, messages: list[Written | None]) -> None:
        store, at = fs.FileSystem.from_uri(self.path)
        self.clear(store, at)

    def clear(self, store: fs.FileSystem, at: str) -> None:
        if store.get_file_info(f"{at}/_temporary").type == fs.FileType.Directory:
            store.delete_dir(f"{at}/_temporary")


def member(data: bytes) -> bytes:
    """``data`` as a gzip member that states its lengths, where they fit their 32 bits."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    size = len(MEMBER) + 8 + len(body) + 8
    lengths = (size, len(data)) if max(size, len(data)) < 1 << 32 else (0, 0)
    return MEMBER + struct.pack("<II", *lengths) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


class WarcSource(DataSource):
    """``spark.read.format("warc").load(path)`` and ``df.write.format("warc").mode("append").save(path)``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        if overwrite:
            raise ValueError("archives are only added to")
        return WarcWriter(self.options["path"])


def read_warc(spark: SparkSession, path: str, columns: str = SCHEMA) -> DataFrame:
    """Records of the archives under ``path``.

    ``columns`` is a DDL schema, a part of ``SCHEMA``; payloads are read only
    where it names them.  A folder that is empty or isn't there gives no rows;
    a file that is not an archive raises.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").schema(columns).option("path", path).load()


def one_line(value) -> object:
    """A header's value: line breaks would end it."""
    return F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def deduplicated(pages: DataFrame, payload: str = "html", page_id: str = "page_id", least_bytes: int = 100) -> DataFrame:
    """``pages`` with payload_bytes, payload_digest (SHA-256, hexadecimal) and refers_to.

    Of pages with equal payloads of at least ``least_bytes`` bytes, the others
    refer to the one with the smallest id.  A null payload is empty; a page
    without an id refers to nothing and nothing to it.  Rows that repeat the
    smallest id refer to nothing.  New columns replace columns of their names.
    Ids may be of any type that has an order.

    Only ids and digests are grouped; what comes of it is a mark for each page
    that repeats another.  Up to ``MARKS`` of those go to the pages, which stay
    where they are; beyond, both are joined by id and digest.
    """
    names = ("payload_bytes", "payload_digest", "refers_to")
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    digests = (F.octet_length(body).cast("long").alias("payload_bytes"), F.sha2(body, 256).alias("payload_digest"))
    of = pages.select(F.col(page_id).alias("__id"), *digests).where(f"payload_bytes >= {least_bytes} and __id is not null").drop("payload_bytes")
    firsts = cut(of.groupBy("payload_digest").agg(F.min("__id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    marks = cut(of.join(firsts, "payload_digest").where("refers_to < __id").distinct())
    marks = marks.withColumnRenamed("payload_digest", "__digest")
    marks = F.broadcast(marks) if marks.count() <= MARKS else marks
    rows = pages.select(*(c for c in pages.columns if c not in names), *digests)
    return rows.join(marks, (rows[page_id] == marks["__id"]) & (rows["payload_digest"] == marks["__digest"]), "left").drop("__id", "__digest")


def write_warc(pages: DataFrame, path: str, payload: str = "html", page_id: str = "page_id", url: str = "url", date: str = "2024-01-01T00:00:00Z") -> None:
    """A record for each page: responses, and revisits of pages that have the same payload.

    Revisits carry the digest and length of the full payload, but no payload.
    Ids are written as URIs ``urn:page:`` with reserved characters escaped; a
    page without one has a record without one.  Pages of an empty table make
    no file.
    """
    pages.sparkSession.dataSource.register(WarcSource)
    rows = deduplicated(pages, payload, page_id)
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    again = F.col("refers_to").isNotNull()
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.url_encode(c.cast("string")), F.lit(">\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(again, "revisit").otherwise("response"),
        F.lit(f"\r\nWARC-Date: {date}\r\n"),
        F.coalesce(F.concat(F.lit("WARC-Record-ID: "), urn(F.col(page_id))), F.lit("")),
        F.coalesce(F.concat(F.lit("WARC-Target-URI: "), one_line(F.col(url).cast("string")), F.lit("\r\n")), F.lit("")),
        F.coalesce(F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), urn(F.col("refers_to"))), F.lit("")),
        F.lit("WARC-Payload-Digest: sha256:"),
        F.col("payload_digest"),
        F.lit("\r\nWARC-Payload-Length: "),
        F.col("payload_bytes").cast("string"),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        (F.lit(len(HTTP)) + F.when(again, 0).otherwise(F.col("payload_bytes"))).cast("string"),
        F.lit("\r\n\r\n" + HTTP),
    )
    record = F.concat(head, F.when(again, "").otherwise(body))
    rows.select(record.alias("record")).write.format("warc").mode("append").option("path", path).save()


def archived(pages: DataFrame, payload: str = "html", page_id: str = "page_id", url: str = "url") -> DataFrame:
    """Pages written to archives in the shared folder and read back.

    Returns (page_id, payload_bytes, payload_digest, record_type, refers_to);
    ids have their own type.  Lengths and digests of responses are those of the
    payloads read back; revisits are read by themselves, headers only, the type
    being a filter that the reader gets.  Equal payloads go by the smallest id;
    repeated rows are archived each, and so are pages without an id; a null
    page is empty; an empty table gives no rows.  The archives go when the
    session ends.
    """
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write_warc(pages, path, payload, page_id, url)
    kind = pages.schema[page_id].dataType
    back = lambda c: F.url_decode(F.regexp_extract(c, "^<urn:page:(.*)>$", 1)).cast(kind)
    headers = "record_type string, record_id string, payload_digest string, refers_to string, payload_length bigint"
    responses = read_warc(spark, path, headers + ", payload binary").where("record_type = 'response'")
    revisits = read_warc(spark, path, headers).where("record_type = 'revisit'")
    digest = {"payload_bytes": F.length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)}
    stated = {"payload_bytes": F.col("payload_length"), "payload_digest": F.regexp_replace("payload_digest", "^sha256:", "")}
    each = [rows.select(back("record_id").alias("page_id"), *(v.alias(k) for k, v in own.items()), "record_type", back("refers_to").alias("refers_to")) for rows, own in ((responses, digest), (revisits, stated))]
    return each[0].unionByName(each[1])
