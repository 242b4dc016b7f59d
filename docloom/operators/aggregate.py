"""Aggregation pipelines: $match, $project, $group, $sort, $limit, $skip, $unwind, $count.

``$group`` leaves out documents without the grouping field.  Its numbers are
doubles, counts included.  A group's ``_id`` is a field, null (one group of
all), or a document of fields.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import Scope, of_schema, quoted
from ..functions.types import WHOLE, RequestError, class_of_type
from .expressions import expression, number
from .filters import compiled
from .project import projected

FOLDS = {"$sum": F.sum, "$min": F.min, "$max": F.max, "$avg": F.avg}


def aggregated(df: DataFrame, pipeline: dict | list, dynamic: str | None = None) -> DataFrame:
    """The result of a pipeline, or of a single stage, as a lazy DataFrame."""
    stages = [pipeline] if isinstance(pipeline, dict) else list(pipeline)
    moved = False
    for k, stage in enumerate(stages):
        if not isinstance(stage, dict) or len(stage) != 1:
            raise RequestError(f"a stage has one operator: {stage!r}")
        name, spec = next(iter(stage.items()))
        if name not in STAGES:
            raise RequestError(f"unknown stage {name}")
        # Rows as the scan gives them are skipped where they are.
        last = k + 1 == len(stages) or "$limit" not in stages[k + 1]
        df = skipped(df, spec) if name == "$skip" and last and not moved else STAGES[name](df, spec, dynamic)
        moved = moved or name in ("$group", "$count", "$sort", "$skip", "$limit")
        if name in ("$group", "$count"):
            dynamic = None
    return df


def match(df: DataFrame, spec: dict, dynamic: str | None = None) -> DataFrame:
    return df.where(compiled(spec, of_schema(df.schema, dynamic)))


def project(df: DataFrame, spec: dict, dynamic: str | None = None) -> DataFrame:
    return projected(df, spec, dynamic=dynamic)


def group(df: DataFrame, spec: dict, dynamic: str | None = None) -> DataFrame:
    """One scan for all accumulators; Spark combines before the shuffle."""
    if not isinstance(spec, dict) or "_id" not in spec:
        raise RequestError("$group takes _id and accumulators")
    scope = of_schema(df.schema, dynamic)
    accumulators = [accumulator(k, v, scope) for k, v in spec.items() if k != "_id"]
    if not accumulators:
        raise RequestError("$group takes at least one accumulator")
    by = spec["_id"]
    if by is None:
        return df.agg(*accumulators).select(F.lit(None).cast("string").alias("_id"), "*")
    keys = _keys(by, scope, dynamic)
    rows = df
    for key in keys.values():
        rows = rows.where(key.isNotNull())
    if "" in keys:
        return rows.groupBy(keys[""].alias("_id")).agg(*accumulators)
    out = rows.groupBy(*(k.alias(f"_id.{n}") for n, k in keys.items())).agg(*accumulators)
    whole = F.struct(*(F.col(quoted(f"_id.{n}")).alias(n) for n in keys)).alias("_id")
    return out.select(whole, *(k for k in spec if k != "_id"))


def _keys(by: Any, scope: Scope, dynamic: str | None) -> dict[str, Column]:
    if isinstance(by, dict) and not any(k.startswith("$") for k in by):
        return {n: _key(v, scope) for n, v in by.items()}
    return {"": _key(by, scope)}


def _key(v: Any, scope: Scope) -> Column:
    if isinstance(v, str) and v.startswith("$"):
        field = scope(v[1:])
        if field is None:
            return F.lit(None).cast("string")
        # Variants cannot be grouped by: their text can.
        return field.at("string") if field.is_variant else field.col
    if isinstance(v, dict):
        return expression(v, scope).col
    raise RequestError(f"a grouping key is a field, null or an expression, not {v!r}")


def accumulator(name: str, spec: Any, scope: Scope) -> Column:
    """``{op: source}``; ``{"$sum": 1}`` counts."""
    if not isinstance(spec, dict) or len(spec) != 1 or next(iter(spec)) not in FOLDS:
        raise RequestError(f"{name}: an accumulator is one of {', '.join(FOLDS)} of a field, number or expression")
    op, source = next(iter(spec.items()))
    if isinstance(source, (int, float)) and not isinstance(source, bool):
        if op == "$sum":
            return (F.count(F.lit(1)) * F.lit(source)).cast("double").alias(name)
        return FOLDS[op](F.lit(float(source))).alias(name)
    field = expression(source, scope)
    if op == "$sum":
        summed = number(source, scope)
        total = F.sum(summed.col.cast("double"))
        # Whole numbers are summed as such up to 64 bits, beyond as doubles.
        return (F.coalesce(F.try_sum(summed.col).cast("double"), total) if type(summed.type) in WHOLE else total).alias(name)
    if op == "$avg":
        return F.avg(number(source, scope).col).cast("double").alias(name)
    out = FOLDS[op](field.col)
    return (out.cast("double") if class_of_type(field.type) == "number" else out).alias(name)


def sort(df: DataFrame, spec: dict | list, dynamic: str | None = None) -> DataFrame:
    """By fields, 1 ascending and -1 descending; nulls count as smallest."""
    scope = of_schema(df.schema, dynamic)
    columns = []
    for name, way in spec.items() if isinstance(spec, dict) else spec:
        if way not in (1, -1):
            raise RequestError(f"{name}: sort by 1 or -1")
        field = scope(name)
        if field is not None:
            col = field.at("double") if field.is_variant else field.col
            columns.append(col.asc() if way == 1 else col.desc())
            if field.is_variant:
                text = field.at("string")
                columns.append(text.asc() if way == 1 else text.desc())
    return df.orderBy(*columns) if columns else df


def limit(df: DataFrame, n: int, dynamic: str | None = None) -> DataFrame:
    if not isinstance(n, int) or n <= 0:
        raise RequestError("$limit takes a positive number")
    return df.limit(n)


def skip(df: DataFrame, n: int, dynamic: str | None = None) -> DataFrame:
    if not isinstance(n, int) or n < 0:
        raise RequestError("$skip takes a number from 0")
    return df.offset(n)


def skipped(df: DataFrame, n: int) -> DataFrame:
    """``df``, a scan with filters, without its first ``n`` rows: a number of rows is dropped as the scan orders them, and the others stay in their tasks.

    Spark's own offset would bring all rows to one task.
    """
    if not isinstance(n, int) or n < 0:
        raise RequestError("$skip takes a number from 0")
    if not n:
        return df
    rows = df.withColumn("__at", F.monotonically_increasing_id())
    dropped = rows.select("__at").orderBy("__at").limit(n).agg(F.max("__at").alias("__upto"), F.count(F.lit(1)).alias("__n"))
    return rows.join(F.broadcast(dropped), F.col("__at") > F.col("__upto")).drop("__at", "__upto", "__n")


def unwind(df: DataFrame, spec: str | dict, dynamic: str | None = None) -> DataFrame:
    """A row for each element of an array; rows without elements go, unless they are to be preserved."""
    path = spec["path"] if isinstance(spec, dict) else spec
    keep = isinstance(spec, dict) and spec.get("preserveNullAndEmptyArrays", False)
    name = path.removeprefix("$")
    if name not in df.columns:
        return df if keep else df.limit(0)
    if not isinstance(df.schema[name].dataType, T.ArrayType):
        return df if keep else df.where(F.col(quoted(name)).isNotNull())
    element = (F.explode_outer if keep else F.explode)(F.col(quoted(name)))
    return df.select(*(element.alias(c) if c == name else F.col(quoted(c)) for c in df.columns))


def count(df: DataFrame, name: str, dynamic: str | None = None) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


STAGES = {"$match": match, "$project": project, "$group": group, "$sort": sort, "$limit": limit, "$skip": skip, "$unwind": unwind, "$count": count}
