"""Updates and deletions as whole-table expressions."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import of_schema, quoted
from ..functions.types import RequestError, decoded, literal, type_of, without_nulls
from .filters import compiled


def deleted(df: DataFrame, filter: dict | None, dynamic: str | None = None) -> DataFrame:
    """The rows that ``filter`` does not hold for; a condition that is null does not hold."""
    return df.where(compiled(filter, of_schema(df.schema, dynamic), negate=True))


def updated(df: DataFrame, filter: dict | None, change: dict, dynamic: str | None = None) -> DataFrame:
    """``df`` with ``$set``, ``$inc`` and ``$unset`` applied where ``filter`` holds.

    Top-level fields are changed; a new one is null elsewhere.  A value has to
    fit the column's type; an ``$inc`` beyond its range raises when the update
    runs, which then changes nothing.
    """
    unknown = set(change) - {"$set", "$inc", "$unset"}
    if unknown or not change:
        raise RequestError(f"an update takes $set, $inc and $unset, not {sorted(unknown)}")
    hit = F.coalesce(compiled(filter, of_schema(df.schema, dynamic)), F.lit(False))
    out: dict = {}
    for name, value in change.get("$set", {}).items():
        _checked(name)
        value = decoded(value)
        old = df.schema[name].dataType if name in df.columns else None
        kind = old if old is not None else without_nulls(type_of(value))
        new = F.lit(None).cast(kind) if value is None else _fitting(value, kind, name)
        out[name] = F.when(hit, new).otherwise(F.col(quoted(name)) if old is not None else F.lit(None).cast(kind))
    for name, step in change.get("$inc", {}).items():
        _checked(name)
        if name not in df.columns or not isinstance(df.schema[name].dataType, T.NumericType):
            raise RequestError(f"{name} holds no numbers")
        col = F.col(quoted(name))
        out[name] = F.when(hit, (col + F.lit(step)).cast(df.schema[name].dataType)).otherwise(col)
    for name in change.get("$unset", {}):
        if name in df.columns:
            out[name] = F.when(~hit, F.col(quoted(name)))
    return df.withColumns(out) if out else df


def _checked(name: str) -> None:
    if "." in name or name.startswith("$"):
        raise RequestError(f"{name}: only top-level fields can be changed")


def _fitting(value, kind: T.DataType, name: str):
    if isinstance(value, (dict, list)):
        return F.from_json(F.lit(json.dumps(value)), kind)
    given = type_of(value)
    numbers = isinstance(given, T.NumericType) and isinstance(kind, T.NumericType)
    if type(given) is not type(kind) and not numbers and not (isinstance(given, T.TimestampType) and isinstance(kind, (T.TimestampNTZType, T.DateType))):
        raise RequestError(f"{name} holds {kind.simpleString()}, not {value!r}")
    return literal(value, kind).cast(kind)
