"""Sharding by best-fit-decreasing bin packing.

Groups of equal texts are indivisible items; only a group larger than a shard
is dealt, row by row, into parts that are items of their own.  Sorted by size,
each item enters the bin with the tightest remaining capacity that holds it,
found in a balanced tree.  For a fixed number of shards, the capacity is the
smallest with which the packing needs no more.

Items of one size are interchangeable, so the packing is done over a histogram:
how many items there are of each size.  In best fit, the bin that took an item
stays the tightest for the next of the same size until it is full, so that a
run of equal items fills bin after bin.  The driver holds the distinct sizes
and one entry for each run that a bin took, never the items; n distinct sizes
need a corpus of n * n / 2 bytes at least.  Items then find their bins by their
rank within their size.
"""

from __future__ import annotations

import math
import random
from collections.abc import Hashable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Parts in which the items of one size, or the rows of one shard, are counted.
PARTS = 256
#: Groups with at least one in so many rows are joined without a shuffle of their rows.
HOT = 4096


class Tree:
    """A treap of (remaining capacity, bin): balanced by random priorities."""

    __slots__ = ("draw", "root")

    def __init__(self) -> None:
        self.root, self.draw = None, random.Random(0).random

    def insert(self, key: tuple[int, int]) -> None:
        low, high = self._split(self.root, key)
        self.root = self._join(self._join(low, [key, self.draw(), None, None]), high)

    def tightest(self, size: int) -> tuple[int, int] | None:
        """Takes out the smallest key whose capacity is at least ``size``."""
        node, best = self.root, None
        while node:
            if node[0][0] >= size:
                best, node = node[0], node[2]
            else:
                node = node[3]
        if best is not None:
            low, high = self._split(self.root, best)
            _, high = self._split(high, (best[0], best[1] + 1))
            self.root = self._join(low, high)
        return best

    def _split(self, node, key):
        if not node:
            return None, None
        if node[0] < key:
            low, high = self._split(node[3], key)
            node[3] = low
            return node, high
        low, high = self._split(node[2], key)
        node[2] = high
        return low, node

    def _join(self, low, high):
        if not low or not high:
            return low or high
        if low[1] > high[1]:
            low[3] = self._join(low[3], high)
            return low
        high[2] = self._join(low, high[2])
        return high


def best_fit_runs(sizes: list[tuple[int, int]], capacity: int, most: int | None = None) -> list[tuple[int, int, int]] | None:
    """Runs (size, number of items, bin) for sizes with their numbers of items, largest first; None where more than ``most`` bins would be needed.

    A size larger than ``capacity`` raises.
    """
    tree, bins, runs = Tree(), 0, []
    for size, left in sizes:
        if size > capacity:
            raise ValueError(f"an item of {size} doesn't fit into {capacity}")
        while left:
            found = tree.tightest(size)
            if found is None:
                if bins == most:
                    return None
                found, bins = (capacity, bins), bins + 1
            taken = min(left, found[0] // size)
            runs.append((size, taken, found[1]))
            left -= taken
            tree.insert((found[0] - taken * size, found[1]))
    return runs


def best_fit(sizes: dict[Hashable, int], capacity: int, most: int | None = None) -> dict[Hashable, int] | None:
    """The bin of each item; None where more than ``most`` bins would be needed.

    Items larger than ``capacity`` raise.  Equal sizes go in the order of
    ``sizes``.
    """
    items = sorted(sizes.items(), key=lambda x: -x[1])
    runs = best_fit_runs(histogram(x for _, x in items), capacity, most)
    if runs is None:
        return None
    bins = [b for _, n, b in runs for _ in range(n)]
    return {item: b for (item, _), b in zip(items, bins)}


def histogram(sizes) -> list[tuple[int, int]]:
    """(size, how often), for sizes in falling order."""
    out: list[tuple[int, int]] = []
    for size in sizes:
        if out and out[-1][0] == size:
            out[-1] = (size, out[-1][1] + 1)
        else:
            out.append((size, 1))
    return out


def level(sizes: list[tuple[int, int]], bins: int) -> list[tuple[int, int, int]]:
    """Best fit into ``bins`` bins, with the smallest capacity that bisection finds to do."""
    if not sizes:
        return []
    low = max(math.ceil(sum(s * n for s, n in sizes) / bins), sizes[0][0])
    out, high, step = None, low, max(1, low // 1000)
    while out is None:
        out = best_fit_runs(sizes, high, bins)
        if out is None:
            low, high, step = high + 1, high + step, 2 * step
    for _ in range(16):
        if low >= high:
            break
        middle = (low + high) // 2
        if (now := best_fit_runs(sizes, middle, bins)) is None:
            low = middle + 1
        else:
            out, high = now, middle
    return out


def sized(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), body.alias("body"))
    hashes = (F.xxhash64("body").alias("h1"), F.xxhash64(F.lit("group"), "body").alias("h2"))
    return rows.select("doc_id", (F.octet_length("body") + 1).cast("long").alias("size"), F.crc32("body").alias("text_crc32"), *hashes, F.monotonically_increasing_id().alias("row"))


def sharded(docs: DataFrame, shards: int | None = 16, capacity: int | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every document.

    Into ``shards`` shards of nearly equal bytes, or into as few as best fit
    needs of ``capacity`` bytes; a single text larger than that raises.
    ``size`` is the text's UTF-8 bytes plus 1; null texts are empty.  Equal
    texts share a shard, but a group larger than a shard is dealt over several,
    row by row, whatever the rows' ids.  ``slot`` numbers a shard's rows from 0
    without gaps, ``grown_shard`` is null as it belongs to another law.  Ties
    of size go by a hash of the text.  Repeated rows and rows without an id are
    placed each; an empty table gives no rows; other columns are not read.
    """
    # The checkpoint fixes the numbers of rows.
    rows = cut(sized(docs, text, doc_id))
    total, longest, n_rows = rows.agg(F.sum("size"), F.max("size"), F.count(F.lit(1))).first()
    if not total:
        return rows.selectExpr("doc_id", "size", "text_crc32", "'bytes' as law", "0 as shard", "cast(0 as bigint) as slot", "cast(null as int) as grown_shard")
    if capacity and longest > capacity:
        raise ValueError(f"a text of {longest} doesn't fit into {capacity}")
    whole = capacity or max(1, math.ceil(total / shards))
    groups = cut(rows.groupBy("h1", "h2").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), F.max("size").alias("one")))
    # Groups beyond a shard, at most as many as there are shards: their rows are dealt into parts, about 16 for each shard that they fill, of a row at least.
    parts = F.least(F.ceil(16 * F.col("bytes") / whole), F.ceil(F.col("bytes") / F.col("one"))).cast("int")
    large = groups.where(F.col("bytes") > whole).select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), parts.alias("parts"))
    # By one number alone a broadcast table is small; the other half of the hash is compared beside it.
    same = (F.col("h1") == F.col("g1")) & (F.col("h2").bitwiseXOR(F.col("g2")) == 0)
    # A group's rows are numbered within blocks of its hashes, so that parts differ by a row or so.
    dealt = rows.join(F.broadcast(large), same).withColumn("block", F.pmod(F.xxhash64("row"), F.lit(PARTS)).cast("int"))
    dealt = dealt.selectExpr("*", "cast(pmod(block * 7919 + row_number() over (partition by h1, h2, block order by row), parts) as int) as part")
    dealt = cut(dealt.select("doc_id", "size", "text_crc32", "h1", "h2", "row", "part"))
    rest = rows.join(F.broadcast(large), same, "left_anti").withColumn("part", F.lit(0))
    items = groups.where(F.col("bytes") <= whole).select("h1", "h2", F.lit(0).alias("part"), "bytes", "n")
    items = cut(items.unionByName(dealt.groupBy("h1", "h2", "part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))))
    sizes = sorted(((r["bytes"], r["m"]) for r in items.groupBy("bytes").agg(F.count(F.lit(1)).alias("m")).collect()), reverse=True)
    runs = best_fit_runs(sizes, capacity) if capacity else level(sizes, shards)
    placed = cut(in_bins(items, sizes, runs))
    # Items of many rows, at most HOT of them, are joined without moving their rows.
    hot = placed.where(F.col("n") >= max(2, n_rows // HOT)).select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("part").alias("g3"), F.col("shard").alias("hot_shard"))
    cold = placed.where(F.col("n") < max(2, n_rows // HOT)).select("h1", "h2", "part", "shard")
    rows = rest.unionByName(dealt.select(*rest.columns)).join(F.broadcast(hot), same & (F.col("part").bitwiseXOR(F.col("g3")) == 0), "left")
    rows = cut(rows.drop("g1", "g2", "g3"))
    names = ("doc_id", "size", "text_crc32", "row", "shard")
    found = rows.where("hot_shard is null").join(cold, ["h1", "h2", "part"]).select(*names)
    return slots(found.unionByName(rows.where("hot_shard is not null").withColumnRenamed("hot_shard", "shard").select(*names)), 1 + max(b for _, _, b in runs))


def in_bins(items: DataFrame, sizes: list[tuple[int, int]], runs: list[tuple[int, int, int]]) -> DataFrame:
    """``items`` with their bins, by their ranks among those of their size."""
    part_of = F.pmod(F.xxhash64("h1", "h2", "part"), F.lit(PARTS)).cast("int").alias("block")
    ranked = items.select("*", part_of).selectExpr("*", "row_number() over (partition by bytes, block order by h1, h2, part) - 1 as within")
    counts = items.select("bytes", part_of).groupBy("bytes", "block").agg(F.count(F.lit(1)).alias("m"))
    before = counts.selectExpr("bytes", "block", "sum(m) over (partition by bytes order by block) - m as before")
    ranked = cut(ranked.join(before, ["bytes", "block"]).selectExpr("h1", "h2", "part", "n", "bytes", "before + within as rank"))
    # Places in the order of sizes: where each size begins, and each run.
    numbers = np.array([n for _, n in sizes], dtype=np.int64)
    falling, firsts = np.array([-s for s, _ in sizes], dtype=np.int64), np.cumsum(numbers) - numbers
    starts = np.cumsum([0] + [n for _, n, _ in runs[:-1]], dtype=np.int64)
    bins = np.array([b for _, _, b in runs], dtype=np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = firsts[np.searchsorted(falling, -batch.column("bytes").to_numpy())] + batch.column("rank").to_numpy()
            shard = bins[np.searchsorted(starts, place, side="right") - 1]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("h1", "h2", "part", "n")), pa.array(shard, pa.int32())], ["h1", "h2", "part", "n", "shard"])

    return ranked.mapInArrow(run, "h1 bigint, h2 bigint, part int, n bigint, shard int")


def slots(rows: DataFrame, shards: int) -> DataFrame:
    """Rows of each shard numbered: within parts of the shard, behind the parts before."""
    parts = max(8, min(PARTS, 16 * PARTS // shards))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int"))
    counts = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.selectExpr("shard", "part", "sum(n) over (partition by shard order by part) - n as before")
    ranked = rows.selectExpr("*", "row_number() over (partition by shard, part order by doc_id, size, text_crc32, row) - 1 as within")
    return ranked.join(before, ["shard", "part"]).selectExpr("doc_id", "size", "text_crc32", "'bytes' as law", "shard", "before + within as slot", "cast(null as int) as grown_shard")
