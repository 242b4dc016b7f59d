"""Filters: from a request's dictionary to one boolean column.

A comparison is made only between values of one class (numbers by value,
strings, booleans, times, binary); between others it is false.  Missing fields
and nulls satisfy no comparison, ``$ne`` included, but they do satisfy ``$nor``,
``$not`` and ``$nin``.  On an array, a comparison holds if any element
satisfies it; for ``$ne`` too: some element differs.
"""

from __future__ import annotations

import math
import re
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import Field, Scope, of_element
from ..functions.types import TYPE_NAMES, RequestError, class_of_type, class_of_value, compared, decoded, literal, type_names

COMPARISONS = {"$eq": "eq", "$ne": "ne", "$gt": "gt", "$gte": "gte", "$lt": "lt", "$lte": "lte"}
EARTH_METRES = 6_378_100.0


def compiled(request: dict | None, scope: Scope, negate: bool = False) -> Column:
    """The condition of a filter; an empty one holds for every row.

    With ``negate``, a condition that is true exactly where the filter's is not
    true: false or null.  Negation is moved inwards to single comparisons, in
    which form it reaches the scan.
    """
    if not isinstance(request, dict) and request is not None:
        raise RequestError(f"a filter is a document, not {request!r}")
    parts = [_entry(k, v, scope, negate) for k, v in (request or {}).items()]
    return _joined(parts, negate) if parts else F.lit(not negate)


def _joined(parts: list[Column], negate: bool) -> Column:
    """All of the conditions or, where each has been negated, one of them."""
    return reduce(or_ if negate else and_, parts)


def negated(condition: Column, negate: bool = True, field: Field | None = None) -> Column:
    """What is true where ``condition`` is false or null; with ``field``, it is null just where the field is, which the scan understands."""
    if not negate:
        return condition
    return (condition if field is None else field.col).isNull() | ~condition


def _decides(field: Field | None, value: Any) -> Field | None:
    """``field``, if a comparison of it with ``value`` is null just where it is null."""
    known = value is not None and not (isinstance(value, (list, tuple)) and any(v is None for v in value))
    return field if field is not None and known and class_of_type(field.type) in ("number", "string", "bool", "time", "binary") else None


def _entry(name: str, value: Any, scope: Scope, negate: bool = False) -> Column:
    if name in ("$and", "$or", "$nor"):
        if not isinstance(value, (list, tuple)) or not value:
            raise RequestError(f"{name} takes a list of filters")
        inner = negate != (name == "$nor")
        return _joined([compiled(v, scope, inner) for v in value], inner != (name != "$and"))
    if name == "$where":
        if not isinstance(value, str):
            raise RequestError("$where takes a SQL expression")
        return negated(F.expr(value), negate)
    if name.startswith("$"):
        raise RequestError(f"unknown operator {name}")
    return on_field(scope(name), value, name, scope, negate)


def on_field(field: Field | None, value: Any, name: str = "", scope: Scope | None = None, negate: bool = False) -> Column:
    """The condition that ``value``, a literal or a document of operators, puts on one field."""
    value = decoded(regular(value))
    if isinstance(value, dict):
        operators = [k for k in value if k.startswith("$")]
        if operators and len(operators) < len(value):
            raise RequestError(f"{name}: operators and fields in one document")
        if operators:
            return _joined([_operator(k, v, value, field, name, negate) for k, v in value.items()], negate)
        # A document of fields: each must match inside.
        if not value:
            return negated(F.lit(False) if field is None else field.col.isNotNull() & F.lit(class_of_type(field.type) == "document"), negate)
        inner = (lambda path: None) if field is None else of_element(field)
        if field is not None and class_of_type(field.type) == "array":
            return negated(_any(field, lambda x: compiled(value, of_element(x))), negate)
        return _joined([on_field(inner(k), v, f"{name}.{k}", negate=negate) for k, v in value.items()], negate)
    if isinstance(value, re.Pattern):
        flags = "i" * bool(value.flags & re.I) + "m" * bool(value.flags & re.M) + "s" * bool(value.flags & re.S) + "x" * bool(value.flags & re.X)
        return negated(_regex(field, value.pattern, flags), negate)
    return negated(_compare("eq", field, value), negate, _decides(field, value))


def regular(value: Any) -> Any:
    """``value`` with regular expressions of extended JSON as the operators that search for them."""
    if isinstance(value, (list, tuple)):
        return [regular(v) for v in value]
    if not isinstance(value, dict):
        return value
    if set(value) == {"$regularExpression"}:
        spec = value["$regularExpression"]
        return {"$regex": spec["pattern"], "$options": spec.get("options", "")}
    return {k: regular(v) for k, v in value.items()}


def searches(value: Any) -> bool:
    return isinstance(value, dict) and "$regex" in value


def _any(field: Field, condition) -> Column:
    """Some element of an array satisfies ``condition``, which gets a Field."""
    return F.exists(field.col, lambda x: F.coalesce(condition(Field(x, field.type.elementType)), F.lit(False)))


def _compare(op: str, field: Field | None, value: Any) -> Column:
    if field is None:
        return F.lit(op == "eq" and value is None)
    kind, of = class_of_type(field.type), class_of_value(value)
    if value is None:
        if field.is_variant:
            found = F.try_variant_get(field.col, "$" + field.path, "variant")
            missing = found.isNull() | F.is_variant_null(found)
            return missing if op == "eq" else ~missing if op == "ne" else F.lit(False)
        return field.col.isNull() if op == "eq" else field.col.isNotNull() if op == "ne" else F.lit(False)
    if kind == "variant":
        return _compare_variant(op, field, value, of)
    if kind == "array":
        if of == "array":
            return _whole_array(op, field, value)
        return _any(field, lambda x: _compare(op, x, value))
    if of == "array" and op == "eq":
        return F.lit(False)
    if kind != of:
        return F.lit(False)
    return compared(op, field.col, field.type, value)


def _whole_array(op: str, field: Field, value: list) -> Column:
    inner = class_of_type(field.type.elementType)
    if any(class_of_value(v) not in (inner, "null") for v in value) or op not in ("eq", "ne"):
        return F.lit(False)
    other = F.array(*(literal(v, field.type.elementType).cast(field.type.elementType) for v in value)).cast(field.type)
    same = field.col.eqNullSafe(other)
    return field.col.isNotNull() & (same if op == "eq" else ~same)


def _compare_variant(op: str, field: Field, value: Any, of: str) -> Column:
    target: dict[str, tuple[str, T.DataType]] = {
        "number": ("double", T.DoubleType()),
        "string": ("string", T.StringType()),
        "bool": ("boolean", T.BooleanType()),
        "time": ("timestamp", T.TimestampType()),
        "binary": ("binary", T.BinaryType()),
    }
    if of not in target:
        return F.lit(False)
    name, t = target[of]
    if of == "number" and isinstance(value, int):
        name, t = ("decimal(38,6)", T.DecimalType(38, 6)) if abs(value) < 10**30 else (name, t)
    # A string would be read as a number or a time: the stored class has to agree.
    stored = F.schema_of_variant(F.try_variant_get(field.col, "$" + field.path, "variant"))
    classes = {"number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL|INT|SMALLINT|TINYINT)", "string": "^STRING$", "bool": "^BOOLEAN$", "time": "^(TIMESTAMP|DATE)", "binary": "^BINARY$"}
    scalar = F.when(stored.rlike(classes[of]), compared(op, field.at(name), t, value))
    element = F.exists(field.at("array<variant>"), lambda x: F.coalesce(F.when(F.schema_of_variant(x).rlike(classes[of]), compared(op, F.try_variant_get(x, "$", name), t, value)), F.lit(False)))
    return F.when(stored.rlike("^ARRAY"), element).otherwise(scalar)


def _operator(op: str, value: Any, siblings: dict, field: Field | None, name: str, negate: bool = False) -> Column:
    if op == "$not":
        return on_field(field, value, name, negate=not negate)
    if op == "$nin":
        return _operator("$in", value, siblings, field, name, not negate)
    compares = op in COMPARISONS or op in ("$in", "$regex")
    return negated(_positive(op, value, siblings, field, name), negate, _decides(field, value) if compares else None)


def _positive(op: str, value: Any, siblings: dict, field: Field | None, name: str) -> Column:
    if op in COMPARISONS:
        return _compare(COMPARISONS[op], field, value)
    if op == "$in":
        if not isinstance(value, (list, tuple)):
            raise RequestError("$in and $nin take a list")
        return _among(field, list(value))
    if op == "$exists":
        there = F.lit(False) if field is None else F.try_variant_get(field.col, "$" + field.path, "variant").isNotNull() if field.is_variant else field.col.isNotNull()
        return there if value else ~there
    if op == "$type":
        wanted = {TYPE_NAMES.get(v, v) for v in (value if isinstance(value, (list, tuple)) else [value])}
        return _has_type(field, wanted)
    if op == "$mod":
        if not isinstance(value, (list, tuple)) or len(value) != 2 or not int(value[0]):
            raise RequestError("$mod takes [divisor, remainder], and the divisor is not 0")
        # What has no whole part in 64 bits, such as NaN, has no remainder.
        return _numeric(field, lambda c: c.try_cast("long") % int(value[0]) == int(value[1]))
    if op == "$regex":
        options = siblings.get("$options", "")
        if searches(value):
            value, options = value["$regex"], value["$options"] or options
        pattern = value.pattern if isinstance(value, re.Pattern) else value
        return _regex(field, pattern, options)
    if op == "$options":
        if "$regex" not in siblings:
            raise RequestError("$options without $regex")
        return F.lit(True)
    if op == "$all":
        parts = value if isinstance(value, (list, tuple)) else [value]
        if not parts:
            return F.lit(False)
        return reduce(and_, [_operator("$elemMatch", v["$elemMatch"], {}, field, name) if isinstance(v, dict) and "$elemMatch" in v else _compare("eq", field, v) for v in parts])
    if op == "$elemMatch":
        by_operator = any(k.startswith("$") and k not in ("$and", "$or", "$nor") for k in value)
        inner = lambda x: on_field(x, value, name) if by_operator else compiled(value, of_element(x))
        if field is not None and field.is_variant:
            return F.exists(field.at("array<variant>"), lambda x: F.coalesce(inner(Field(x, field.type)), F.lit(False)))
        return _any(field, inner) if field is not None and class_of_type(field.type) == "array" else F.lit(False)
    if op == "$size":
        if field is None:
            return F.lit(False)
        if field.is_variant:
            return F.size(field.at("array<variant>")) == int(value)
        return (F.size(field.col) == int(value)) & field.col.isNotNull() if class_of_type(field.type) == "array" else F.lit(False)
    if op in ("$geoWithin", "$geoIntersects", "$near", "$nearSphere"):
        return _geo(op, value, siblings, field, name)
    if op in ("$maxDistance", "$minDistance"):
        if not {"$near", "$nearSphere"} & siblings.keys():
            raise RequestError(f"{op} without $near")
        return F.lit(True)
    raise RequestError(f"unknown operator {op}")


def _among(field: Field | None, values: list) -> Column:
    if field is None:
        return F.lit(any(v is None for v in values))
    kind = class_of_type(field.type)
    patterns = [on_field(field, v) for v in values if searches(v)]
    if patterns:
        return reduce(or_, [_among(field, [v for v in values if not searches(v)]), *patterns])
    if kind in ("array", "variant"):
        parts = [on_field(field, v) if isinstance(v, re.Pattern) else _compare("eq", field, decoded(v)) for v in values]
        return reduce(or_, parts) if parts else F.lit(False)
    values = [decoded(v) if isinstance(v, dict) else v for v in values]
    plain = [v for v in values if class_of_value(v) == kind]
    if kind == "number" and isinstance(field.type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        plain = [int(v) for v in plain if math.isfinite(v) and v == int(v) and abs(v) < 1 << 63]
    parts = []
    if plain:
        parts.append(field.col.isin([literal(v, field.type) for v in plain]) if kind in ("time", "binary") else field.col.isin(plain))
    if any(v is None for v in values):
        parts.append(field.col.isNull())
    parts += [on_field(field, v) for v in values if isinstance(v, re.Pattern)]
    return reduce(or_, parts) if parts else F.lit(False)


def _numeric(field: Field | None, condition) -> Column:
    if field is None:
        return F.lit(False)
    kind = class_of_type(field.type)
    if kind == "variant":
        return condition(field.at("double"))
    if kind == "array":
        return _any(field, lambda x: _numeric(x, condition))
    return condition(field.col) if kind == "number" else F.lit(False)


def _regex(field: Field | None, pattern: str, options: str = "") -> Column:
    if set(options) - set("imsx"):
        raise RequestError(f"unknown options {options!r} of a regular expression")
    if field is None:
        return F.lit(False)
    pattern = f"(?{options}){pattern}" if options else pattern
    kind = class_of_type(field.type)
    if kind == "array":
        return _any(field, lambda x: _regex(x, pattern))
    if kind == "variant":
        return F.when(F.schema_of_variant(F.try_variant_get(field.col, "$" + field.path, "variant")) == "STRING", field.at("string").rlike(pattern))
    return field.col.rlike(pattern) if kind == "string" else F.lit(False)


def _has_type(field: Field | None, wanted: set[str]) -> Column:
    if field is None:
        return F.lit(False)
    if field.is_variant:
        stored = F.schema_of_variant(F.try_variant_get(field.col, "$" + field.path, "variant"))
        names = {"double": "^(DOUBLE|DECIMAL)", "long": "^BIGINT", "int": "^BIGINT", "number": "^(BIGINT|DOUBLE|DECIMAL)", "string": "^STRING", "bool": "^BOOLEAN", "object": "^OBJECT", "array": "^ARRAY", "null": "^VOID", "date": "^(TIMESTAMP|DATE)", "binData": "^BINARY"}
        return F.coalesce(reduce(or_, [stored.rlike(names[w]) for w in wanted if w in names] or [F.lit(False)]), F.lit(False))
    yes = field.col.isNotNull() & F.lit(bool(type_names(field.type) & wanted))
    if isinstance(field.type, T.ArrayType) and type_names(field.type.elementType) & wanted:
        yes = yes | _any(field, lambda x: x.col.isNotNull())
    return yes | field.col.isNull() if "null" in wanted else yes


# Geometry: points are [x, y] arrays, structs of two numbers, or documents with coordinates.


def point_of(field: Field) -> tuple[Column, Column]:
    t = field.type
    if isinstance(t, T.ArrayType) and isinstance(t.elementType, T.NumericType):
        return F.get(field.col, F.lit(0)), F.get(field.col, F.lit(1))
    if isinstance(t, T.StructType):
        if "coordinates" in t.names:
            return point_of(Field(field.col.getField("coordinates"), t["coordinates"].dataType))
        if len(t) >= 2 and all(isinstance(f.dataType, T.NumericType) for f in t.fields[:2]):
            return field.col.getField(t.names[0]), field.col.getField(t.names[1])
    raise RequestError("a point is an array or struct of two numbers, or has coordinates")


def angle(x: Column, y: Column, lon: float, lat: float) -> Column:
    """The angle between two points on a sphere, in radians."""
    dlat, dlon = F.radians(y - F.lit(float(lat))), F.radians(x - F.lit(float(lon)))
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(y)) * math.cos(math.radians(lat)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def flat(x: Column, y: Column, x0: float, y0: float) -> Column:
    return F.sqrt(F.pow(x - F.lit(float(x0)), 2) + F.pow(y - F.lit(float(y0)), 2))


def in_polygon(x: Column, y: Column, corners: list) -> Column:
    """A ray from the point crosses the border an odd number of times."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(corners, corners[1:] + corners[:1]):
        if y1 != y2:
            at = F.lit(float(x1)) + (y - float(y1)) * ((x2 - x1) / (y2 - y1))
            crossings = crossings + (((F.lit(float(y1)) > y) != (F.lit(float(y2)) > y)) & (x < at)).cast("int")
    return crossings % 2 == 1


def distance(op: str, value: Any, field: Field) -> tuple[Column, Any, Any]:
    """Distance from the point of ``$near``, and its limits."""
    x, y = point_of(field)
    if isinstance(value, dict) and "$geometry" in value:
        lon, lat = value["$geometry"]["coordinates"]
        return angle(x, y, lon, lat) * EARTH_METRES, value.get("$minDistance"), value.get("$maxDistance")
    measure = angle if op == "$nearSphere" else flat
    return measure(x, y, *list(value)[:2]), None, None


def nearness(request: dict, scope: Scope) -> Column | None:
    """The order that a filter with ``$near`` asks for."""
    for name, value in (request or {}).items():
        for op in ("$near", "$nearSphere"):
            if isinstance(value, dict) and op in value and (field := scope(name)) is not None:
                return distance(op, value[op], field)[0]
    return None


def _geo(op: str, value: Any, siblings: dict, field: Field | None, name: str) -> Column:
    if field is None:
        return F.lit(False)
    if op in ("$near", "$nearSphere"):
        how, least, most = distance(op, value, field)
        least, most = siblings.get("$minDistance", least), siblings.get("$maxDistance", most)
        out = how.isNotNull()
        out = out if least is None else out & (how >= float(least))
        return out if most is None else out & (how <= float(most))
    x, y = point_of(field)
    if "$box" in value:
        (x1, y1), (x2, y2) = value["$box"]
        return x.between(float(min(x1, x2)), float(max(x1, x2))) & y.between(float(min(y1, y2)), float(max(y1, y2)))
    if "$center" in value:
        (x0, y0), radius = value["$center"]
        return flat(x, y, x0, y0) <= float(radius)
    if "$centerSphere" in value:
        (x0, y0), radius = value["$centerSphere"]
        return angle(x, y, x0, y0) <= float(radius)
    if "$polygon" in value:
        return in_polygon(x, y, [tuple(p) for p in value["$polygon"]])
    shape = value.get("$geometry", {})
    if shape.get("type") == "Polygon":
        rings = [[tuple(p) for p in (ring[:-1] if ring[0] == ring[-1] else ring)] for ring in shape["coordinates"]]
        holes = [in_polygon(x, y, r) for r in rings[1:]]
        return reduce(and_, [in_polygon(x, y, rings[0]), *(~h for h in holes)])
    if shape.get("type") == "Point" and op == "$geoIntersects":
        return (x == float(shape["coordinates"][0])) & (y == float(shape["coordinates"][1]))
    raise RequestError(f"{name}: {op} takes $box, $center, $centerSphere, $polygon or a polygon as $geometry")
