"""Dotted paths into rows: structs, arrays of structs, array positions and variants."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Field:
    """A column at a path, and its type; inside a variant, ``path`` leads on from ``col``."""

    col: Column
    type: T.DataType
    path: str = ""

    @property
    def is_variant(self) -> bool:
        return isinstance(self.type, T.VariantType)

    def at(self, kind: str) -> Column:
        """The variant's value at the path as ``kind``; null where it is something else."""
        return F.try_variant_get(self.col, "$" + self.path, kind)


Scope = Callable[[str], "Field | None"]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def of_schema(schema: T.StructType, dynamic: str | None = None) -> Scope:
    """Finds paths in the columns of ``schema``; with ``dynamic``, in that variant column where no column has the name."""

    def find(path: str) -> Field | None:
        if path in schema.names:
            return Field(F.col(quoted(path)), schema[path].dataType)
        head, _, rest = path.partition(".")
        if head in schema.names:
            return step(Field(F.col(quoted(head)), schema[head].dataType), rest.split(".") if rest else [])
        if dynamic is not None:
            return step(Field(F.col(quoted(dynamic)), T.VariantType()), path.split("."))
        return None

    return find


def of_element(field: Field) -> Scope:
    """Finds paths in a struct or variant that stands alone, such as an array's element."""
    return lambda path: step(field, path.split("."))


def step(field: Field, names: list[str]) -> Field | None:
    if not names:
        return field
    name, rest = names[0], names[1:]
    t = field.type
    if isinstance(t, T.VariantType):
        here = f"[{name}]" if name.isdigit() else f'["{name}"]' if '"' not in name else f"['{name}']"
        return step(Field(field.col, t, field.path + here), rest)
    if isinstance(t, T.StructType):
        return step(Field(field.col.getField(name), t[name].dataType), rest) if name in t.names else None
    if isinstance(t, T.MapType):
        return step(Field(F.try_element_at(field.col, F.lit(name)), t.valueType), rest)
    if isinstance(t, T.ArrayType):
        if name.isdigit():
            return step(Field(F.get(field.col, F.lit(int(name))), t.elementType), rest)
        inner = step(Field(F.lit(None).cast(t.elementType), t.elementType), names)
        if inner is None:
            return None
        values = F.transform(field.col, lambda x: step(Field(x, t.elementType), names).col)
        if isinstance(inner.type, T.ArrayType):
            return Field(F.flatten(values), inner.type)
        return Field(values, T.ArrayType(inner.type))
    return None
