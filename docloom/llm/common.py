"""Shared helpers: reading tables, shared storage, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a batch of texts or sets between Spark and Python.
ARROW_BYTES = 8 << 20
#: Keys that may be dealt into chunks in a join: each has more than this part of its rows.
HOT = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` names it.  Where that is unset, a local session
    gets a temporary folder and any other the warehouse.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        at = tempfile.mkdtemp(prefix="docloom-")
    else:
        at = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_docloom"
    spark.conf.set("spark.checkpoint.dir", at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """``df`` materialised in the shared folder, without its lineage."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own for ``name`` in this session's part of the shared folder, which is deleted when the session ends."""
    at = f"{shared_dir(spark)}/docloom-{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return f"{at}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared storage that is read no more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` written to ``path`` and read back: without lineage, and with the size that it really has.

    A checkpoint keeps its plan's estimate, in which joins multiply; over the
    rounds of an iteration these grow to numbers of millions of digits.
    """
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt_join(many: DataFrame, one: DataFrame, counts: DataFrame, keys: list[str], by: list[str], chunk: int = 4096) -> DataFrame:
    """Inner join of ``many`` with ``one``, which has one row for each key.

    ``counts`` says in ``n`` how many rows of ``many`` each key has.  A key of
    more than ``chunk`` rows and more than a part in ``HOT`` of all (there are
    at most ``HOT`` such keys, which are broadcast) is dealt into chunks by a
    hash of the columns ``by``, and the other side's row goes to each of them.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    most = max(chunk, -(-total // HOT))
    hot = counts.where(F.col("n") > most).select(*keys, F.ceil(F.col("n") / most).cast("int").alias("__chunks"))
    chunks = F.coalesce("__chunks", F.lit(1))
    many = many.join(F.broadcast(hot), keys, "left").withColumn("__chunk", F.pmod(F.xxhash64(*by), chunks).cast("int"))
    one = one.join(F.broadcast(hot), keys, "left").withColumn("__chunk", F.explode(F.sequence(F.lit(0), chunks - 1)))
    return many.drop("__chunks").join(one.drop("__chunks"), [*keys, "__chunk"]).drop("__chunk")


def small_arrow(df: DataFrame) -> DataFrame:
    """``df``, whose session, unless it sets another limit, from now on hands Python workers batches of at most ``ARROW_BYTES`` bytes, but for single rows.

    A batch is held by the JVM, outside its heap, and by the worker at once;
    with long texts, Spark's own limit is a large part of an executor.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key) == f"{64 << 20}b":
        conf.set(key, f"{ARROW_BYTES}b")
    return df


def text_or_empty(df: DataFrame, col: str = "text"):
    return F.coalesce(df[col].cast("string"), F.lit(""))


def strings(column: pa.Array) -> list[str]:
    """Python strings of an Arrow column, nulls as empty strings."""
    return [x or "" for x in column.to_pylist()]


def small_batches(batches: Iterable[pa.RecordBatch], rows: int = 256, by: str = "text", most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows and, but for single rows, ``most_bytes`` of column ``by``."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(by)), 0), dtype=np.int64)
        ends = np.cumsum(sizes)
        start, n = 0, batch.num_rows
        while start < n:
            before = ends[start - 1] if start else 0
            stop = min(start + rows, max(start + 1, int(np.searchsorted(ends, before + most_bytes, side="right"))))
            yield batch.slice(start, stop - start)
            start = stop


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables that hold whole groups of rows; the input is sorted by ``keys``.

    Memory holds one batch and the group that it cut.
    """
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        now = now if rest is None else pa.concat_tables([rest, now])
        starts = group_starts(now, keys)
        last = int(starts[-1])
        if last:
            yield now.slice(0, last).combine_chunks()
        rest = now.slice(last)
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks()


def group_starts(rows: pa.Table, keys: list[str]) -> np.ndarray:
    """First row of each run of equal keys."""
    new = np.zeros(rows.num_rows, dtype=bool)
    new[0] = True
    for k in keys:
        v = rows.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


class Forest:
    """Connected components of rows 0 to n-1 from arrays of pairs."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while True:
            x, y = label[a], label[b]
            differ = x != y
            if not differ.any():
                return
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            low = np.minimum(x, y)
            np.minimum.at(label, np.maximum(x, y), low)
            while True:
                jumped = label[label]
                if np.array_equal(jumped, label):
                    break
                label[:] = jumped
