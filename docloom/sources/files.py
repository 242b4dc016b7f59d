"""Reading and writing documents: JSON lines (extended JSON too), CSV, Parquet."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Wrappers of extended JSON with one scalar inside, and what they become; 128-bit decimals become doubles.
SCALARS = {"$oid": "string", "$numberLong": "bigint", "$numberInt": "int", "$numberDouble": "double", "$numberDecimal": "double", "$symbol": "string", "$code": "string"}


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None, extended: bool = True) -> DataFrame:
    """Documents of JSON lines; the schema is inferred unless given, and wrappers of extended JSON are taken off."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    df = reader.json(path)
    return unwrapped(df) if extended else df


def unwrapped(df: DataFrame) -> DataFrame:
    """``df`` with ``{"$oid": x}`` and its like replaced by x, at any depth."""
    return df.select(*(_plain(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema))


def _plain(col, t: T.DataType):
    if isinstance(t, T.ArrayType) and _wraps(t.elementType):
        return F.transform(col, lambda x: _plain(x, t.elementType))
    if not isinstance(t, T.StructType):
        return col
    if len(t) == 1 and (name := t.names[0]) in SCALARS:
        return col[name].cast(SCALARS[name])
    if t.names == ["$date"]:
        inner, kind = col["$date"], t["$date"].dataType
        if isinstance(kind, T.StructType):
            return F.timestamp_millis(inner["$numberLong"].cast("bigint"))
        return F.to_timestamp(inner) if isinstance(kind, T.StringType) else F.timestamp_millis(inner.cast("bigint"))
    if set(t.names) == {"$binary", "$type"}:
        return F.unbase64(col["$binary"])
    if t.names == ["$timestamp"]:
        inner = col["$timestamp"]
        return F.shiftleft(inner["t"].cast("bigint"), 32).bitwiseOR(inner["i"].cast("bigint"))
    if t.names == ["$regularExpression"]:
        return col["$regularExpression"]
    if t.names in (["$minKey"], ["$maxKey"]):
        return F.when(col.isNotNull(), F.lit(t.names[0]))
    if t.names == ["$undefined"]:
        return F.lit(None).cast("string")
    if t.names == ["$binary"]:
        return F.unbase64(col["$binary"]["base64"])
    if not _wraps(t):
        return col
    return F.when(col.isNotNull(), F.struct(*(_plain(col.getField(f.name), f.dataType).alias(f.name) for f in t)))


def _wraps(t: T.DataType) -> bool:
    if isinstance(t, T.ArrayType):
        return _wraps(t.elementType)
    return isinstance(t, T.StructType) and any(f.name.startswith("$") or _wraps(f.dataType) for f in t)


def read_dynamic(spark: SparkSession, path: str, column: str = "doc") -> DataFrame:
    """One variant column of JSON lines whose documents differ in shape; lines that are no JSON are null."""
    return spark.read.text(path).select(F.try_parse_json("value").alias(column))


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A CSV file with a header; empty fields are null."""
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    return (reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).csv(path)


def to_json(df: DataFrame, column: str = "value") -> DataFrame:
    """Each row as one JSON document, without its null fields."""
    return df.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns))).alias(column))


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def as_lines(docs: list[dict]) -> list[str]:
    return [json.dumps(d, default=str) for d in docs]
