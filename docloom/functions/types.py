"""Classes of values and columns, literals, and extended JSON."""

from __future__ import annotations

import base64
import datetime as dt
import decimal
import math
import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class RequestError(ValueError):
    """A request that cannot be compiled."""


def class_of_type(t: T.DataType) -> str:
    """number, string, bool, time, binary, array, document, variant or null."""
    if isinstance(t, T.NumericType):
        return "number"
    for kinds, name in (
        ((T.StringType, T.CharType, T.VarcharType), "string"),
        ((T.BooleanType,), "bool"),
        ((T.TimestampType, T.TimestampNTZType, T.DateType), "time"),
        ((T.BinaryType,), "binary"),
        ((T.ArrayType,), "array"),
        ((T.StructType, T.MapType), "document"),
        ((T.VariantType,), "variant"),
        ((T.NullType,), "null"),
    ):
        if isinstance(t, kinds):
            return name
    raise RequestError(f"columns of type {t.simpleString()} cannot be queried")


def class_of_value(v: Any) -> str:
    if v is None:
        return "null"
    for kinds, name in (
        ((bool,), "bool"),
        ((int, float, decimal.Decimal), "number"),
        ((str,), "string"),
        ((dt.datetime, dt.date), "time"),
        ((bytes, bytearray), "binary"),
        ((list, tuple), "array"),
        ((dict,), "document"),
        ((re.Pattern,), "regex"),
    ):
        if isinstance(v, kinds):
            return name
    raise RequestError(f"values of type {type(v).__name__} cannot be compared")


def literal(v: Any, t: T.DataType | None = None) -> Column:
    """``v`` as a literal that compares with a column of type ``t``."""
    if isinstance(v, dt.date):
        if isinstance(t, T.TimestampNTZType):
            return F.to_timestamp_ntz(F.lit(at_midnight(v).replace(tzinfo=None).isoformat(sep=" ", timespec="microseconds")))
        if isinstance(t, T.DateType) and not isinstance(v, dt.datetime):
            return F.lit(v)
        moment = at_midnight(v)
        moment = moment if moment.tzinfo else moment.replace(tzinfo=dt.timezone.utc)
        return F.timestamp_micros(F.lit(round(moment.timestamp() * 1_000_000)))
    if isinstance(v, bytearray):
        return F.lit(bytes(v))
    return F.lit(v)


def at_midnight(v: dt.date) -> dt.datetime:
    return v if isinstance(v, dt.datetime) else dt.datetime(v.year, v.month, v.day)


#: Largest and smallest value of whole-number columns.
WHOLE = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31, T.LongType: 63}


def compared(op: str, col: Column, t: T.DataType, v: Any) -> Column:
    """``col op v`` for values of one class; whole-number columns keep whole literals, so that the comparison reaches the scan."""
    bits = next((b for k, b in WHOLE.items() if isinstance(t, k)), None)
    if bits is not None and not isinstance(v, bool) and isinstance(v, (int, float, decimal.Decimal)):
        if v != v:  # NaN is above every number
            return _all(col, op in ("lt", "lte", "ne"))
        if v in (math.inf, -math.inf) or not -(1 << bits) <= v < (1 << bits):
            return _all(col, op == "ne" or op in (("lt", "lte") if v > 0 else ("gt", "gte")))
        if v != int(v):
            if op in ("eq", "ne"):
                return _all(col, op == "ne")
            v = math.floor(v) if op in ("gt", "lte") else math.ceil(v)
        v = int(v)
    other = literal(v, t)
    return {"eq": col == other, "ne": col != other, "gt": col > other, "gte": col >= other, "lt": col < other, "lte": col <= other}[op]


def _all(col: Column, yes: bool) -> Column:
    return col.isNotNull() if yes else F.lit(False)


# Names and numbers of the types of documents, as clients write them in $type.
TYPE_NAMES = {1: "double", 2: "string", 3: "object", 4: "array", 5: "binData", 6: "undefined", 7: "objectId", 8: "bool", 9: "date", 10: "null", 11: "regex", 13: "javascript", 16: "int", 17: "timestamp", 18: "long"}


def type_names(t: T.DataType) -> set[str]:
    """Names that ``$type`` accepts for a column."""
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return {"double", "number"}
    if isinstance(t, T.LongType):
        return {"long", "number"}
    if isinstance(t, (T.IntegerType, T.ShortType, T.ByteType)):
        return {"int", "number"}
    if isinstance(t, T.DecimalType):
        return {"decimal", "number"}
    return {{"string": "string", "bool": "bool", "time": "date", "binary": "binData", "array": "array", "document": "object", "null": "null", "variant": "object"}[class_of_type(t)]}


def decoded(v: Any) -> Any:
    """A value of extended JSON ($oid, $date, $numberLong, $binary and the like) as a plain one."""
    if isinstance(v, list):
        return [decoded(x) for x in v]
    if not isinstance(v, dict):
        return v
    keys = set(v)
    if keys == {"$oid"}:
        return v["$oid"]
    if keys == {"$date"}:
        return _moment(v["$date"])
    if keys in ({"$numberLong"}, {"$numberInt"}):
        return int(next(iter(v.values())))
    if keys == {"$numberDouble"}:
        return float(v["$numberDouble"])
    if keys == {"$numberDecimal"}:
        return float(v["$numberDecimal"])
    if keys == {"$undefined"}:
        return None
    if keys == {"$symbol"} or keys == {"$code"}:
        return next(iter(v.values()))
    if keys == {"$binary"} and isinstance(v["$binary"], dict):
        return base64.b64decode(v["$binary"]["base64"])
    if keys == {"$binary", "$type"}:
        return base64.b64decode(v["$binary"])
    if keys == {"$timestamp"}:
        return v["$timestamp"]["t"] << 32 | v["$timestamp"]["i"]
    if keys == {"$regularExpression"}:
        return {"pattern": v["$regularExpression"]["pattern"], "options": v["$regularExpression"]["options"]}
    if keys in ({"$minKey"}, {"$maxKey"}):
        return next(iter(keys))
    return {k: decoded(x) for k, x in v.items()}


def _moment(v: Any) -> dt.datetime:
    if isinstance(v, dict):
        v = int(v["$numberLong"])
    if isinstance(v, (int, float)):
        return dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(milliseconds=v)
    moment = dt.datetime.fromisoformat(v.replace("Z", "+00:00"))
    return moment if moment.tzinfo else moment.replace(tzinfo=dt.timezone.utc)


def schema_of(docs: list[dict]) -> T.StructType:
    """The schema that holds all ``docs``: whole numbers are long, mixed numbers double, absent fields null."""
    names: dict[str, T.DataType] = {}
    for doc in docs:
        for k, v in doc.items():
            if k.startswith("$"):
                raise RequestError(f"a field cannot be called {k}")
            names[k] = merged(names.get(k, T.NullType()), type_of(v), k)
    return T.StructType([T.StructField(k, t) for k, t in names.items()])


def type_of(v: Any) -> T.DataType:
    kind = class_of_value(v)
    if kind == "array":
        item: T.DataType = T.NullType()
        for x in v:
            item = merged(item, type_of(x), "an array")
        return T.ArrayType(item)
    if kind == "document":
        return schema_of([v])
    if kind == "number":
        return T.LongType() if isinstance(v, int) else T.DoubleType()
    return {"null": T.NullType, "bool": T.BooleanType, "string": T.StringType, "time": T.TimestampType, "binary": T.BinaryType}[kind]()


def merged(a: T.DataType, b: T.DataType, where: str) -> T.DataType:
    """The type that holds values of both."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        whole = all(type(x) in WHOLE for x in (a, b))
        return (a if WHOLE[type(a)] > WHOLE[type(b)] else b) if whole else T.DoubleType()
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(merged(a.elementType, b.elementType, where))
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        names = {f.name: f.dataType for f in a}
        for f in b:
            names[f.name] = merged(names.get(f.name, T.NullType()), f.dataType, f"{where}.{f.name}")
        return T.StructType([T.StructField(k, t) for k, t in names.items()])
    raise RequestError(f"{where} holds {a.simpleString()} and {b.simpleString()}; a dynamic collection can hold both")


def without_nulls(t: T.DataType) -> T.DataType:
    """``t`` with types of fields that were only ever null as strings, which files can hold."""
    if isinstance(t, T.NullType):
        return T.StringType()
    if isinstance(t, T.ArrayType):
        return T.ArrayType(without_nulls(t.elementType))
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, without_nulls(f.dataType)) for f in t])
    return t
