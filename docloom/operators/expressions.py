"""Computed values: field references, literals, ``$add``, ``$multiply``, ``$mod`` and ``$slice``."""

from __future__ import annotations

from functools import reduce
from operator import add, mul
from typing import Any

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import Field, Scope
from ..functions.types import RequestError, class_of_type, decoded, literal, type_of


def expression(value: Any, scope: Scope) -> Field:
    """A column for an expression; a missing field is null, and so is arithmetic with it."""
    if isinstance(value, str) and value.startswith("$"):
        field = scope(value.removeprefix("$$ROOT.").removeprefix("$"))
        if field is None:
            return Field(F.lit(None).cast("double"), T.DoubleType())
        return Field(field.at("double"), T.DoubleType()) if field.is_variant else field
    value = decoded(value)
    if isinstance(value, dict):
        if len(value) == 1 and next(iter(value)).startswith("$"):
            return _operator(*next(iter(value.items())), scope)
        fields = {k: expression(v, scope) for k, v in value.items()}
        return Field(F.struct(*(f.col.alias(k) for k, f in fields.items())), T.StructType([T.StructField(k, f.type) for k, f in fields.items()]))
    if isinstance(value, (list, tuple)):
        items = [expression(v, scope) for v in value]
        return Field(F.array(*(x.col for x in items)), T.ArrayType(items[0].type if items else T.StringType()))
    return Field(literal(value), type_of(value))


def number(value: Any, scope: Scope) -> Field:
    field = expression(value, scope)
    if class_of_type(field.type) != "number":
        return Field(F.lit(None).cast("double"), T.DoubleType())
    return field


def _operator(op: str, value: Any, scope: Scope) -> Field:
    if op == "$literal":
        return Field(literal(value), type_of(value))
    args = list(value) if isinstance(value, (list, tuple)) else [value]
    if op in ("$add", "$multiply"):
        parts = [number(v, scope) for v in args]
        if not parts:
            raise RequestError(f"{op} takes a list of numbers")
        whole = all(isinstance(p.type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) for p in parts)
        kind = T.LongType() if whole else T.DoubleType()
        return Field(reduce(add if op == "$add" else mul, [p.col.cast(kind) for p in parts]), kind)
    if op == "$mod":
        a, b = (number(v, scope) for v in args)
        return Field(F.try_mod(a.col, b.col), a.type)
    if op == "$slice":
        field = expression(args[0], scope)
        return Field(sliced(field, args[1] if len(args) == 2 else list(args[1:])), field.type)
    raise RequestError(f"unknown expression {op}")


def sliced(field: Field, spec: Any):
    """The first n elements, the last n where n is negative, or [skip, n]."""
    if class_of_type(field.type) != "array":
        return field.col
    size = F.size(field.col)
    if isinstance(spec, (list, tuple)):
        skip, n = int(spec[0]), int(spec[1])
        start = F.lit(skip + 1) if skip >= 0 else F.greatest(size + skip + 1, F.lit(1))
        return F.slice(field.col, start, F.lit(n))
    n = int(spec)
    if n >= 0:
        return F.slice(field.col, F.lit(1), F.lit(n))
    return F.slice(field.col, F.greatest(size + n + 1, F.lit(1)), F.lit(-n))
