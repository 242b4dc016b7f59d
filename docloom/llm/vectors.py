"""Near-duplicates of embeddings: sign hashing in several tables, exact verification.

Each table cuts the space by random hyperplanes; vectors on the same side of
all of a table's planes share a bucket.  The number of planes follows the
number of vectors, so that buckets keep their size, and the number of tables
follows from the recall wanted at the threshold: two vectors at angle a agree
on a plane with probability 1 - a / pi.  Candidates are verified by their
cosine in double precision.  Equal vectors are merged first; a bucket of any
size is compared in bounded groups.

A table moves each vector once, so that few tables of large buckets cost less
than many of small ones.  Which earlier tables a pair has met in already is
worked out anew where it is verified, instead of moving the signs: planes and
vectors are rounded to whole numbers whose products and sums a double holds
exactly, so that a sign is the same wherever it is computed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cells import dealt_cells
from .common import Forest, cut, dealt_join, group_starts, small_arrow, whole_groups
from .components import connected_components
from .simhash import mixed

#: Rows of a group that are compared with the others at once, and rows of a group's sides at most.
BLOCK, CHUNK = 256, 8192


def tables_for(n: int, cosine: float, missed: float, bucket: int) -> tuple[int, int]:
    """Planes of a table and number of tables, for ``n`` vectors and a chance ``missed`` of overlooking a pair at the threshold."""
    planes = min(62, max(4, math.ceil(math.log2(max(n, 1) / bucket)))) if n > bucket else 4
    same = (1 - math.acos(cosine) / math.pi) ** planes
    return planes, math.ceil(math.log(missed) / math.log1p(-same))


def usable(vector: str) -> str:
    """SQL: the vector can be compared."""
    return f"{vector} is not null and not exists({vector}, x -> x is null or isnan(x) or abs(x) = double('Infinity')) and exists({vector}, x -> x <> 0)"


def planes_of(dim: int, planes: int, tables: int, seed: int) -> np.ndarray:
    """The normals of all tables' planes, one a column, as whole numbers of up to 13 bits."""
    return np.rint(np.random.default_rng([seed, dim]).standard_normal((dim, planes * tables)) * 1024)


def sides_of(x: np.ndarray, normals: np.ndarray, planes: int) -> np.ndarray:
    """For each vector and table, the sides of the table's planes that it is on, as bits of a number."""
    whole = np.rint(x / np.abs(x).max(axis=1, keepdims=True) * (1 << 20))
    sides = (whole @ normals >= 0).reshape(len(x), -1, planes)
    return (sides * np.left_shift(np.uint64(1), np.arange(planes, dtype=np.uint64))).sum(axis=2, dtype=np.uint64)


def in_buckets(planes: int, tables: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn: dict[int, np.ndarray] = {}
        salts = np.arange(1, tables + 1, dtype=np.uint64)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                dims = np.asarray(batch.column("vec").value_lengths())
                for dim in np.unique(dims).tolist():
                    rows = batch.filter(pa.array(dims == dim))
                    x = np.asarray(rows.column("vec").flatten(), dtype=np.float64).reshape(-1, dim)
                    if dim not in drawn:
                        drawn[dim] = planes_of(dim, planes, tables, seed)
                    keys = mixed(sides_of(x, drawn[dim], planes), salts[None, :] + np.uint64(dim << 20))
                    with np.errstate(over="ignore"):
                        short = x.astype(np.float32)
                    exact = (short == x).all(axis=1)
                    stored = [b"f" + s.tobytes() if e else b"d" + v.tobytes() for s, v, e in zip(short, x, exact.tolist())]
                    again = pa.array(np.repeat(np.arange(len(x)), tables))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(keys.ravel().view(np.int64)),
                            pa.array(np.tile(np.arange(tables, dtype=np.int32), len(x))),
                            rows.column("class").take(again),
                            rows.column("copies").take(again),
                            pa.array(stored, pa.binary()).take(again),
                        ],
                        ["cell", "t", "class", "copies", "vec"],
                    )

    return run


def vectors_of(rows: pa.Table) -> list[np.ndarray]:
    """The group's vectors in double precision; those of a cell have one length, unless hashes collide."""
    return [np.frombuffer(v[1:], dtype=np.float32 if v[:1] == b"f" else np.float64).astype(np.float64) for v in rows.column("vec").to_pylist()]


def units(x: np.ndarray) -> np.ndarray:
    out = x / np.abs(x).max(axis=1, keepdims=True)
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


def verified(cosine: float, planes: int, tables: int, seed: int):
    """For groups of candidates: how many vectors each class is linked to, and a spanning forest of its links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn: dict[int, np.ndarray] = {}
        for rows in whole_groups(batches, ["cell", "i", "j"]):
            starts = group_starts(rows, ["cell", "i", "j"])
            ends = np.append(starts[1:], rows.num_rows)
            classes, where = np.unique(rows.column("class").to_numpy(), return_inverse=True)
            links = np.zeros(len(classes), dtype=np.int64)
            forest = Forest(len(classes))
            for start, end in zip(starts, ends):
                group = rows.slice(start, end - start)
                within = group.column("i")[0] == group.column("j")[0]
                raw, t_of = vectors_of(group), group.column("t").to_numpy()
                dims = np.array([len(v) for v in raw])
                # A cell has one table and one length of vectors, unless hashes collide.
                for t, dim in sorted({*zip(t_of.tolist(), dims.tolist())}):
                    own = np.flatnonzero((t_of == t) & (dims == dim))
                    side, local = group.column("side").to_numpy()[own], where[start:end][own]
                    copies = group.column("copies").to_numpy()[own]
                    left, right = (np.arange(len(own)),) * 2 if within else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
                    if not len(left) or not len(right):
                        continue
                    x = np.stack([raw[k] for k in own])
                    u = units(x)
                    if dim not in drawn:
                        drawn[dim] = planes_of(dim, planes, tables, seed)
                    signs = None
                    for lo in range(0, len(left), BLOCK):
                        part, others = left[lo : lo + BLOCK], right[lo:] if within else right
                        a, b = np.nonzero(u[part] @ u[others].T >= cosine)
                        a, b = part[a], others[b]
                        new = (a < b) & (local[a] != local[b]) if within else local[a] != local[b]
                        a, b = a[new], b[new]
                        # A pair counts in the first of the tables in which it meets.
                        if t and len(a):
                            if signs is None:
                                signs = sides_of(x, drawn[dim][:, : t * planes], planes)
                            again = [(signs[a[k : k + 8192]] == signs[b[k : k + 8192]]).any(axis=1) for k in range(0, len(a), 8192)]
                            new = ~np.concatenate(again)
                            a, b = a[new], b[new]
                        np.add.at(links, local[a], copies[b])
                        np.add.at(links, local[b], copies[a])
                        forest.add(local[a], local[b])
            found = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(classes[found]), pa.array(classes[forest.label[found]]), pa.array(links[found])], ["a", "b", "links"])

    return run


def near_vectors(
    vectors: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", cosine: float = 0.9, missed: float = 1e-3, bucket: int = 2048, seed: int = 7
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector.

    Vectors whose cosine is at least ``cosine`` are linked; a pair at the
    threshold is overlooked with probability ``missed`` at most, closer ones
    more rarely.  ``n_links`` counts the other rows linked directly, equal
    vectors included; ``component_id`` is the smallest id reachable; ``kept``
    marks the row that has it.  Null, empty and zero vectors, those with null
    or non-finite components, and rows without an id are linked with nothing,
    not even with their copies.  Vectors of different lengths are not
    compared.  Ids name vectors: rows of one id should hold one vector.
    Repeated rows are vectors each; an empty table gives no rows; other
    columns are not read.
    """
    rows = small_arrow(vectors).selectExpr(f"cast(`{vec_id}` as bigint) as vec_id", f"cast(`{vector}` as array<double>) as vec")
    ok = f"vec_id is not null and {usable('vec')}"
    good = rows.where(ok)
    classes = cut(good.groupBy("vec").agg(F.min("vec_id").alias("class"), F.count(F.lit(1)).alias("copies")))
    planes, tables = tables_for(classes.count(), cosine, missed, bucket)
    placed = classes.mapInArrow(in_buckets(planes, tables, seed), "cell bigint, t int, class bigint, copies bigint, vec binary")
    found = cut(dealt_cells(placed, "cell", "class", CHUNK).mapInArrow(verified(cosine, planes, tables, seed), "a bigint, b bigint, links bigint"))
    links = found.groupBy(F.col("a").alias("class")).agg(F.sum("links").alias("links"))
    roots = connected_components(found).select(F.col("node").alias("class"), "root")
    named = classes.join(links, "class", "left").join(roots, "class", "left")
    named = cut(named.select("vec", "class", F.coalesce("root", "class").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    least = named.groupBy("root").agg(F.min("class").alias("component_id"))
    named = cut(named.join(least, "root").select("vec", "n_links", "component_id"))
    linked = dealt_join(good, named, classes.select("vec", F.col("copies").alias("n")), ["vec"], ["vec_id"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(f"not ({ok})").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
