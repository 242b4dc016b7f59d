"""Filters and projections over documents that arrive as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions.paths import of_schema
from ..operators.filters import compiled
from ..operators.project import projected


def followed(spark: SparkSession, path: str, schema: T.StructType | str, filter: dict | None = None, projection: dict | list | None = None, source: str = "json") -> DataFrame:
    """A streaming DataFrame of matching documents from new files under ``path``; the same compiler as for stored ones."""
    rows = spark.readStream.schema(schema).format(source).load(path)
    return projected(rows.where(compiled(filter, of_schema(rows.schema))), projection, filter)
