"""Projections: which fields of the documents come back.

Values say what to do with a field: 1 or true keeps it, 0 or false drops it,
``{"$slice": …}`` keeps a part of an array, ``"a.$": 1`` the first element that
the filter's condition on ``a`` holds for, and an expression computes a field.
``_id`` stays unless it is dropped, where the collection has it.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import Field, of_schema, quoted
from ..functions.types import RequestError, class_of_type
from .expressions import expression, sliced
from .filters import on_field


def is_switch(v: Any) -> bool:
    return isinstance(v, (bool, int, float))


def projected(df: DataFrame, spec: dict | list | None, filter: dict | None = None, dynamic: str | None = None) -> DataFrame:
    """``df`` with the fields that ``spec`` keeps; an empty one keeps all, unknown fields are ignored."""
    if isinstance(spec, (list, tuple)):
        spec = dict.fromkeys(spec, 1)
    if not spec:
        return df
    keep = [k for k, v in spec.items() if is_switch(v) and v and k != "_id"]
    drop = [k for k, v in spec.items() if is_switch(v) and not v and k != "_id"]
    made = {k: v for k, v in spec.items() if not is_switch(v)}
    slices = {k: v["$slice"] for k, v in made.items() if isinstance(v, dict) and set(v) == {"$slice"} and not _is_expression(v["$slice"])}
    made = {k: v for k, v in made.items() if k not in slices}
    if keep and drop:
        raise RequestError("a projection keeps fields or drops them, not both")
    with_id = bool(spec.get("_id", 1))
    if made and drop:
        raise RequestError("a projection with computed fields cannot drop others")
    if not keep and not made:
        # Nothing is kept by name: all stay but what is dropped, or just _id where that alone is asked for.
        if set(spec) == {"_id"} and with_id:
            return df.select(*(["_id"] if "_id" in df.columns else []))
        out = df
        for name in drop if with_id else [*drop, "_id"]:
            out = _dropped(out, name)
        return _sliced(out, slices)
    return df.select(*_kept(df, [*(["_id"] if with_id else []), *keep, *slices], made, slices, filter or {}, dynamic))


def _is_expression(v: Any) -> bool:
    return isinstance(v, (list, tuple)) and bool(v) and isinstance(v[0], str)


def _kept(df: DataFrame, names: list[str], made: dict, slices: dict, filter: dict, dynamic: str | None) -> list[Column]:
    scope = of_schema(df.schema, dynamic)
    tops: dict[str, list[list[str]]] = {}
    out: dict[str, Column] = {}
    for name in names:
        if name.endswith(".$"):
            field = scope(name[:-2])
            if field is not None and class_of_type(field.type) == "array":
                condition = filter.get(name[:-2])
                met = F.filter(field.col, lambda x: F.coalesce(on_field(Field(x, field.type.elementType), _inner(condition)), F.lit(False))) if condition is not None else field.col
                out[name[:-2]] = F.slice(met, 1, 1)
        elif name in df.columns:
            tops[name] = [[]]
        elif (head := name.split(".")[0]) in df.columns:
            tops.setdefault(head, []).append(name.split(".")[1:])
        elif dynamic and (field := scope(name)) is not None:
            out[name] = F.try_variant_get(field.col, "$" + field.path, "variant")
    for head, paths in tops.items():
        col = F.col(quoted(head))
        if head in slices:
            out[head] = sliced(Field(col, df.schema[head].dataType), slices[head])
        elif [] in paths:
            out[head] = col
        elif (part := _part(Field(col, df.schema[head].dataType), paths)) is not None:
            out[head] = part
    out |= {k: expression(v, scope).col for k, v in made.items()}
    # Columns of the input keep their order; new ones follow.
    order = [c for c in df.columns if c in out] + [c for c in out if c not in df.columns]
    return [out[c].alias(c) for c in order]


def _inner(condition: Any) -> Any:
    return condition["$elemMatch"] if isinstance(condition, dict) and "$elemMatch" in condition else condition


def _part(field: Field, paths: list[list[str]]) -> Column | None:
    """The part of a struct, or of the structs of an array, at some paths."""
    t = field.type
    if [] in paths or isinstance(t, T.VariantType):
        return field.col
    if isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StructType):
        return F.transform(field.col, lambda x: _part(Field(x, t.elementType), paths))
    if not isinstance(t, T.StructType):
        return None
    inner: dict[str, list[list[str]]] = {}
    for p in paths:
        if p[0] in t.names:
            inner.setdefault(p[0], []).append(p[1:])
    parts = {k: _part(Field(field.col.getField(k), t[k].dataType), v) for k, v in inner.items()}
    parts = {k: v for k, v in parts.items() if v is not None}
    return F.when(field.col.isNotNull(), F.struct(*(v.alias(k) for k, v in parts.items()))) if parts else None


def _dropped(df: DataFrame, name: str) -> DataFrame:
    if name in df.columns:
        return df.drop(F.col(quoted(name)))
    head, _, rest = name.partition(".")
    if rest and head in df.columns and isinstance(df.schema[head].dataType, T.StructType) and of_schema(df.schema)(name) is not None:
        return df.withColumn(head, F.col(quoted(head)).dropFields(rest))
    return df


def _sliced(df: DataFrame, slices: dict) -> DataFrame:
    here = {k: sliced(Field(F.col(quoted(k)), df.schema[k].dataType), v) for k, v in slices.items() if k in df.columns}
    return df.withColumns(here) if here else df
