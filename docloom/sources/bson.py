"""BSON files: concatenated binary documents, as dump tools write them.

The layout is that of the public specification: a document is its length, its
elements (type, name, value) and a zero byte.  Files are read where tasks run,
one file a partition, a document at a time.
"""

from __future__ import annotations

import base64
import datetime as dt
import decimal
import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
BATCH_BYTES = 8 << 20


def decode(data: bytes) -> dict[str, Any]:
    """A document's fields, with plain values: times as ISO text, object ids in hexadecimal, binary in Base64, as JSON can hold."""
    out, at = _document(data, 0)
    if at != len(data):
        raise ValueError("bytes behind a document")
    return out


def _text(data: bytes, at: int) -> tuple[str, int]:
    end = data.index(0, at)
    return data[at:end].decode("utf-8", "replace"), end + 1


def _document(data: bytes, at: int) -> tuple[dict[str, Any], int]:
    size = struct.unpack_from("<i", data, at)[0]
    end = at + size
    if size < 5 or end > len(data) or data[end - 1]:
        raise ValueError("a document's length is wrong")
    out: dict[str, Any] = {}
    at += 4
    while at < end - 1:
        kind = data[at]
        name, at = _text(data, at + 1)
        out[name], at = _value(kind, data, at)
    return out, end


def _value(kind: int, data: bytes, at: int) -> tuple[Any, int]:
    def number(layout: str) -> tuple[Any, int]:
        return struct.unpack_from(layout, data, at)[0], at + struct.calcsize(layout)

    def counted() -> tuple[str, int]:
        size = struct.unpack_from("<i", data, at)[0]
        return data[at + 4 : at + 3 + size].decode("utf-8", "replace"), at + 4 + size

    if kind == 0x01:
        return number("<d")
    if kind in (0x02, 0x0D, 0x0E):  # text, code, symbol
        return counted()
    if kind == 0x03:
        return _document(data, at)
    if kind == 0x04:
        items, at = _document(data, at)
        return list(items.values()), at
    if kind == 0x05:
        size, sub = struct.unpack_from("<iB", data, at)
        start = at + 5
        inner = data[start + 4 : start + size] if sub == 2 else data[start : start + size]  # the old subtype repeats the length
        return base64.b64encode(inner).decode(), start + size
    if kind in (0x06, 0x0A):
        return None, at
    if kind == 0x07:
        return data[at : at + 12].hex(), at + 12
    if kind == 0x08:
        return bool(data[at]), at + 1
    if kind == 0x09:
        millis, at = number("<q")
        try:
            return (EPOCH + dt.timedelta(milliseconds=millis)).isoformat(timespec="milliseconds"), at
        except OverflowError:
            return None, at
    if kind == 0x0B:
        pattern, at = _text(data, at)
        options, at = _text(data, at)
        return {"pattern": pattern, "options": options}, at
    if kind == 0x0C:
        name, at = counted()
        return {"ref": name, "id": data[at : at + 12].hex()}, at + 12
    if kind == 0x0F:
        end = at + struct.unpack_from("<i", data, at)[0]
        at += 4
        return counted()[0], end
    if kind == 0x10:
        return number("<i")
    if kind in (0x11, 0x12):
        return number("<Q" if kind == 0x11 else "<q")
    if kind == 0x13:
        return _decimal(data[at : at + 16]), at + 16
    if kind in (0xFF, 0x7F):
        return "$minKey" if kind == 0xFF else "$maxKey", at
    raise ValueError(f"unknown type {kind:#x} in a document")


def _decimal(raw: bytes) -> float:
    """A 128-bit decimal as a double."""
    low, high = struct.unpack("<QQ", raw)
    sign = -1 if high >> 63 else 1
    if high >> 58 & 31 == 31:
        return float("nan")
    if high >> 58 & 31 == 30:
        return sign * float("inf")
    if high >> 61 & 3 == 3:  # a coefficient beyond the format's range counts as zero
        return 0.0
    digits = (high & ((1 << 49) - 1)) << 64 | low
    return float(decimal.Decimal(sign * digits).scaleb((high >> 49 & 0x3FFF) - 6176))


def encode(document: dict[str, Any]) -> bytes:
    """A document's bytes; whole numbers take 64 bits, fields that are None are nulls."""
    body = b"".join(_element(k, v) for k, v in document.items())
    return struct.pack("<i", len(body) + 5) + body + b"\0"


def _element(name: str, v: Any) -> bytes:
    if "\0" in name:
        raise ValueError("a field's name holds a zero byte")

    def of(kind: int, data: bytes) -> bytes:
        return bytes([kind]) + name.encode() + b"\0" + data

    if v is None:
        return of(0x0A, b"")
    if isinstance(v, bool):
        return of(0x08, bytes([v]))
    if isinstance(v, int):
        return of(0x12, struct.pack("<q", v))
    if isinstance(v, (float, decimal.Decimal)):
        return of(0x01, struct.pack("<d", float(v)))
    if isinstance(v, str):
        raw = v.encode()
        return of(0x02, struct.pack("<i", len(raw) + 1) + raw + b"\0")
    if isinstance(v, (bytes, bytearray)):
        return of(0x05, struct.pack("<iB", len(v), 0) + bytes(v))
    if isinstance(v, dt.date):
        moment = v if isinstance(v, dt.datetime) else dt.datetime(v.year, v.month, v.day)
        moment = moment if moment.tzinfo else moment.replace(tzinfo=dt.timezone.utc)
        return of(0x09, struct.pack("<q", (moment - EPOCH) // dt.timedelta(milliseconds=1)))
    if isinstance(v, (list, tuple)):
        return of(0x04, encode({str(k): x for k, x in enumerate(v)}))
    if isinstance(v, dict):
        return of(0x03, encode(v))
    raise ValueError(f"{name}: values of type {type(v).__name__} have no place in a document")


class File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class BsonReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[File]:
        store, at = fs.FileSystem.from_uri(self.path)
        info = store.get_file_info(at)
        found = store.get_file_info(fs.FileSelector(at, recursive=True)) if info.type == fs.FileType.Directory else [info]
        whole = self.path.removesuffix("/")
        own = [f"{whole}{f.path.removeprefix(at.removesuffix('/'))}" for f in sorted(found, key=lambda f: f.path) if f.is_file and not f.base_name.startswith(("_", "."))]
        return [File(p) for p in own] or [File("")]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        rows, held = [], 0
        for data in documents(partition.path):
            rows.append(json.dumps(decode(data), ensure_ascii=False))
            held += len(data)
            if held > BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], ["value"])
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], ["value"])


def documents(path: str) -> Iterator[bytes]:
    """The documents of a file, as bytes; compressed files by their endings."""
    store, at = fs.FileSystem.from_uri(path)
    with store.open_input_stream(at, compression="detect", buffer_size=1 << 20) as file:
        while head := file.read(4):
            size = struct.unpack("<i", head)[0] if len(head) == 4 else 0
            rest = file.read(size - 4) if size >= 5 else b""
            if size < 5 or len(rest) != size - 4:
                raise ValueError(f"a document breaks off in {path}")
            yield head + rest


@dataclass
class Written(WriterCommitMessage):
    name: str


class BsonWriter(DataSourceWriter):
    """A file for each task, written beside and moved into place when all are done."""

    def __init__(self, path: str) -> None:
        self.path, self.beside = path, f"{path}/_temporary/{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Written:
        store, at = fs.FileSystem.from_uri(self.beside)
        store.create_dir(at, recursive=True)
        name = f"part-{uuid.uuid4().hex}.bson"
        with store.open_output_stream(f"{at}/{name}", buffer_size=1 << 20) as out:
            for row in iterator:
                out.write(encode({k: v for k, v in row.asDict(recursive=True).items() if v is not None}))
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        store, at = fs.FileSystem.from_uri(self.path)
        _, beside = fs.FileSystem.from_uri(self.beside)
        for m in messages:
            if m:
                store.move(f"{beside}/{m.name}", f"{at}/{m.name}")
        store.delete_dir(f"{at}/_temporary")

    def abort(self, messages: list[Written | None]) -> None:
        store, at = fs.FileSystem.from_uri(self.path)
        if store.get_file_info(f"{at}/_temporary").type == fs.FileType.Directory:
            store.delete_dir(f"{at}/_temporary")


class BsonSource(DataSource):
    """``spark.read.format("bson").load(path)``, one column of JSON; ``df.write.format("bson").mode("append").save(path)``."""

    @classmethod
    def name(cls) -> str:
        return "bson"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema: T.StructType) -> BsonReader:
        return BsonReader(self.options["path"])

    def writer(self, schema: T.StructType, overwrite: bool) -> BsonWriter:
        if overwrite:
            raise ValueError("BSON files are only added to")
        return BsonWriter(self.options["path"])


def read_bson(spark: SparkSession, path: str, schema: T.StructType | str | None = None, column: str = "doc") -> DataFrame:
    """Documents of BSON files: typed columns by a schema, or else one variant column.

    By a schema, Base64 text becomes binary, and ISO text times.  Missing
    fields are null.  A file that breaks off within a document raises.
    """
    spark.dataSource.register(BsonSource)
    lines = spark.read.format("bson").option("path", path).load()
    if schema is None:
        return lines.select(F.parse_json("value").alias(column))
    return lines.select(F.from_json("value", schema).alias("d")).select("d.*")


def write_bson(df: DataFrame, path: str) -> None:
    """Adds the rows as documents, without their null fields, a file for each partition."""
    df.sparkSession.dataSource.register(BsonSource)
    df.write.format("bson").mode("append").option("path", path).save()
