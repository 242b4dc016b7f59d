"""Databases of named collections, kept as tables of the session's catalog.

A collection is created by its first insert.  Inserts append files and are
visible as a whole when their job has committed.  Updates and deletions write
the new table beside the old one, put the old one aside, take its name and then
drop it.  Where that breaks off, the next access completes it.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import of_schema, quoted
from ..functions.types import RequestError, decoded, merged, schema_of, without_nulls
from ..operators.aggregate import aggregated, skipped, sort as sorted_by
from ..operators.filters import compiled, nearness
from ..operators.mutate import deleted, updated
from ..operators.project import projected
from .cursor import Cursor

NAME = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")
#: Ends of the names of a table that is being written, and of one that is being replaced.
BESIDE, ASIDE = "__next", "__old"


class Database:
    """A namespace of collections; ``Database(spark, "test")["zips"]`` is one."""

    def __init__(self, spark: SparkSession, name: str = "test") -> None:
        if not NAME.match(name):
            raise RequestError(f"{name!r} cannot name a database")
        self.spark, self.name = spark, name
        self.views: dict[str, DataFrame] = {}
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {quoted(name)}")

    def __getitem__(self, name: str) -> Collection:
        return Collection(self, name)

    def collection_names(self) -> list[str]:
        held = {t.name.removesuffix(ASIDE) for t in self.spark.catalog.listTables(self.name) if not t.isTemporary and not t.name.endswith(BESIDE)}
        return sorted(held | self.views.keys())

    def register(self, name: str, df: DataFrame) -> Collection:
        """A collection to read, over any DataFrame."""
        out = Collection(self, name)
        self.views[out.name] = df
        return out

    def of_namespace(self, namespace: str) -> Collection:
        """``db.collection``, split at the first dot; the database is this one."""
        database, _, name = namespace.partition(".")
        if database != self.name or not name:
            raise RequestError(f"{namespace} is not in database {self.name}")
        return self[name]

    def load(self, name: str, path: str) -> Collection:
        """A collection from Parquet files that :meth:`Collection.save` wrote."""
        out = self[name]
        out._replace(self.spark.read.parquet(path))
        return out

    def drop(self) -> None:
        self.views.clear()
        self.spark.sql(f"DROP DATABASE IF EXISTS {quoted(self.name)} CASCADE")


class Collection:
    """Documents under one name.  ``find`` and ``aggregate`` give lazy DataFrames."""

    def __init__(self, database: Database, name: str) -> None:
        name = name.replace(".", "_")
        if not NAME.match(name):
            raise RequestError(f"{name!r} cannot name a collection")
        self.database, self.name = database, name
        self.table = f"{quoted(database.name)}.{quoted(name)}"

    @property
    def spark(self) -> SparkSession:
        return self.database.spark

    def exists(self) -> bool:
        return self.name in self.database.views or self._there() or self._recovered()

    def _there(self, end: str = "") -> bool:
        return self.spark.catalog.tableExists(f"{self.database.name}.{self.name}{end}")

    def _recovered(self) -> bool:
        """Completes a replacement that broke off while no table had the collection's name; the new one was whole by then."""
        if not self._there(ASIDE):
            return False
        self._rename(BESIDE if self._there(BESIDE) else ASIDE, "")
        self._drop(ASIDE)
        return True

    def _rename(self, old: str, new: str) -> None:
        self.spark.sql(f"ALTER TABLE {self._named(old)} RENAME TO {self._named(new)}")

    def _drop(self, end: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self._named(end)}")

    def _named(self, end: str) -> str:
        return f"{quoted(self.database.name)}.{quoted(self.name + end)}"

    @property
    def df(self) -> DataFrame:
        if self.name in self.database.views:
            return self.database.views[self.name]
        if not self.exists():
            raise RequestError(f"there is no collection {self.name}")
        return self.spark.table(self.table)

    @property
    def dynamic(self) -> str | None:
        """The variant column, where that is all the collection has."""
        fields = self.df.schema.fields
        return fields[0].name if len(fields) == 1 and isinstance(fields[0].dataType, T.VariantType) else None

    # Reading

    def find(self, filter: dict | None = None, projection: dict | list | None = None, sort: dict | None = None, skip: int = 0, limit: int = 0) -> DataFrame:
        """Matching documents; in the order of distance where the filter has ``$near`` and no sort is given."""
        df, dynamic = self.df, self.dynamic
        scope = of_schema(df.schema, dynamic)
        out = df.where(compiled(filter, scope)) if filter else df
        near = None if sort else nearness(filter, scope)
        if sort:
            out = sorted_by(out, sort, dynamic)
        elif near is not None:
            out = out.orderBy(near)
        if skip:
            out = out.offset(skip) if sort or near is not None or limit else skipped(out, skip)
        out = out.limit(abs(limit)) if limit else out
        return projected(out, projection, filter, dynamic)

    def find_cursor(self, *args: Any, batch_size: int = 101, **more: Any) -> Cursor:
        return Cursor(self.find(*args, **more), f"{self.database.name}.{self.name}", batch_size)

    def aggregate(self, pipeline: dict | list) -> DataFrame:
        return aggregated(self.df, pipeline, self.dynamic)

    def count(self, filter: dict | None = None) -> int:
        return self.find(filter).count()

    def distinct(self, field: str, filter: dict | None = None) -> DataFrame:
        """Distinct values of a field, nulls left out, in a column called value; of an array, its elements."""
        rows = self.find(filter)
        found = of_schema(rows.schema, self.dynamic)(field)
        if found is None:
            raise RequestError(f"there is no field {field}")
        col = found.at("string") if found.is_variant else found.col
        value = F.explode(col) if isinstance(found.type, T.ArrayType) else col
        return rows.select(value.alias("value")).where("value is not null").distinct()

    # Writing

    def insert_many(self, docs: list[dict], dynamic: bool = False) -> int:
        """Appends documents and returns how many; fields that the collection lacks are added to it."""
        docs = [decoded(d) for d in docs]
        if not docs:
            return 0
        if dynamic or self.exists() and self.dynamic:
            from .files import as_lines

            rows = self.spark.createDataFrame([(line,) for line in as_lines(docs)], "value string")
            self._append(rows.select(F.parse_json("value").alias(self.dynamic if self.exists() else "doc")))
            return len(docs)
        schema = without_nulls(schema_of(docs))
        self.insert_frame(self.spark.createDataFrame([_row(d, schema) for d in docs], schema))
        return len(docs)

    def insert_one(self, doc: dict) -> int:
        return self.insert_many([doc])

    def insert_frame(self, df: DataFrame) -> None:
        """Appends the rows of a DataFrame; columns are matched by name."""
        self._append(df)

    def delete_many(self, filter: dict | None = None) -> int:
        """Deletes matching documents and returns how many."""
        rows, dynamic = self.df, self.dynamic
        return self._changed(filter, lambda counted: deleted(counted, filter, dynamic), rows, dynamic)

    def update_many(self, filter: dict | None, change: dict) -> int:
        """Changes matching documents and returns how many."""
        rows, dynamic = self.df, self.dynamic
        updated(rows, filter, change, dynamic)  # a wrong request raises here
        return self._changed(filter, lambda counted: updated(counted, filter, change, dynamic), rows, dynamic)

    def _changed(self, filter: dict | None, change: Callable[[DataFrame], DataFrame], rows: DataFrame, dynamic: str | None) -> int:
        """Rewrites the collection where a document matches; they are counted while it is read."""
        hit = compiled(filter, of_schema(rows.schema, dynamic))
        if rows.where(hit).isEmpty():
            return 0
        seen = Observation()
        # A filter of the rewrite must not go below the count.
        self._replace(change(rows.observe(seen, F.count_if(hit).alias("n"))))
        return seen.get["n"]

    def drop(self) -> None:
        self.database.views.pop(self.name, None)
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def save(self, path: str, mode: str = "errorifexists") -> None:
        """Writes the collection as Parquet, to any store that Spark writes to."""
        self.df.write.mode(mode).parquet(path)

    def compare(self, other: Collection | DataFrame) -> tuple[bool, str]:
        """Whether two collections hold the same documents, as often, and what differs."""
        a, b = self.df, other.df if isinstance(other, Collection) else other
        if sorted(a.columns) != sorted(b.columns):
            return False, f"fields differ: {sorted(set(a.columns) ^ set(b.columns))}"
        found = self.difference(other).agg(F.sum("only_here"), F.sum("only_there")).first()
        only_a, only_b = (x or 0 for x in found)
        return (not only_a and not only_b), "" if not only_a and not only_b else f"{only_a} documents only here, {only_b} only there"

    def difference(self, other: Collection | DataFrame) -> DataFrame:
        """Documents that one of two collections has more often, and how much more: only_here, only_there.

        Both have the same fields.  Documents are counted in one grouping,
        combined before the shuffle.
        """
        a, b = self.df, other.df if isinstance(other, Collection) else other
        both = a.withColumn("__n", F.lit(1)).unionByName(b.withColumn("__n", F.lit(-1)))
        n = F.sum("__n")
        sums = both.groupBy(*(quoted(c) for c in a.columns)).agg(n.alias("__n")).where("__n <> 0")
        return sums.select(*(quoted(c) for c in a.columns), F.greatest("__n", F.lit(0)).alias("only_here"), F.greatest(-F.col("__n"), F.lit(0)).alias("only_there"))

    def _append(self, df: DataFrame) -> None:
        if self.name in self.database.views:
            raise RequestError(f"{self.name} is a view")
        if not self.exists():
            df.write.format("parquet").saveAsTable(self.table)
            return
        old, new = self.df.schema, df.schema
        both = merged(old, new, self.name)
        widened = [f.name for f in old if both[f.name].dataType != f.dataType]
        if widened:
            # Old files cannot hold the wider type: they are rewritten once.
            self._replace(_as(self.df, both))
        else:
            added = [f"{quoted(f.name)} {f.dataType.simpleString()}" for f in both if f.name not in old.names]
            if added:
                self.spark.sql(f"ALTER TABLE {self.table} ADD COLUMNS ({', '.join(added)})")
        _as(df, both).write.mode("append").format("parquet").saveAsTable(self.table)

    def _replace(self, df: DataFrame) -> None:
        if self.name in self.database.views:
            raise RequestError(f"{self.name} is a view")
        there = self.exists()
        self._drop(BESIDE)
        df.write.format("parquet").saveAsTable(self._named(BESIDE))
        if there:
            self._drop(ASIDE)
            self._rename("", ASIDE)
        self._rename(BESIDE, "")
        self._drop(ASIDE)


def _row(value: Any, t: T.DataType) -> Any:
    if value is None:
        return None
    if isinstance(t, T.StructType):
        return tuple(_row(value.get(f.name), f.dataType) for f in t)
    if isinstance(t, T.ArrayType):
        return [_row(x, t.elementType) for x in value]
    return float(value) if isinstance(t, T.DoubleType) else value


def _as(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with the fields of ``schema``, missing ones null."""
    return df.select(*((_cast(F.col(quoted(f.name)), df.schema[f.name].dataType, f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema))


def _cast(col, old: T.DataType, new: T.DataType):
    if old == new:
        return col
    if isinstance(new, T.StructType):
        parts = [(_cast(col.getField(f.name), old[f.name].dataType, f.dataType) if f.name in old.names else F.lit(None).cast(f.dataType)).alias(f.name) for f in new]
        return F.when(col.isNotNull(), F.struct(*parts))
    if isinstance(new, T.ArrayType):
        return F.transform(col, lambda x: _cast(x, old.elementType, new.elementType))
    return col.cast(new)
