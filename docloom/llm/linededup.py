"""Deleting passages of lines that an earlier place has already.

Lines are hashed.  A gram is the shortest run of lines from a line on that
holds ``noise`` words; a window is the shortest that holds ``words``.  In each
window the gram with the smallest hash is selected, so that two places which
share a passage of ``words`` words select the same gram in it (winnowing).
Selected grams are joined with the gram's first place in the corpus; each match
is extended both ways, line by line, and if the shared run holds ``words``
words, the later copy goes.  As a gram's first place may lack the rest of a
passage that two later places share, windows of several lines that select a
smaller gram are joined with their own first place too: no repeated window is
missed.  A run is deleted only where an earlier place has
the same lines, so that the first copy of every line stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, dealt_join, small_arrow, small_batches


def line_hashes(text: str) -> tuple[list[int], list[int]]:
    """Hash and number of words of each line; white space is folded."""
    hashes, words = [], []
    for line in text.split("\n"):
        tokens = line.split()
        hashes.append(xxhash.xxh64_intdigest(" ".join(tokens)) >> 1)
        words.append(len(tokens))
    return hashes, words


def winnowed(hashes: list[int], words: list[int], noise: int, least: int) -> tuple[list[int], list[int]]:
    """Lines at which a selected gram or a window begins, and its hash."""
    n = len(hashes)
    before = np.concatenate([[0], np.cumsum(words)])
    if before[-1] < least:
        return [], []
    # A run that begins with lines without words is found by its first line with some.
    at = np.flatnonzero(np.diff(before))
    starts = before[at]
    gram_end = np.searchsorted(before, starts + noise)  # exclusive
    window_end = np.searchsorted(before, starts + least)
    h = np.array(hashes, dtype=np.uint64)
    grams: list[int] = []
    for k, i in enumerate(at.tolist()):
        if gram_end[k] > n:
            break
        grams.append(xxhash.xxh64_intdigest(h[i : gram_end[k]].tobytes()) >> 1)
    picked: dict[tuple[int, int], None] = {}
    stops = np.searchsorted(gram_end[: len(grams)], window_end, side="right").tolist()
    for j in range(int(np.searchsorted(window_end, n, side="right"))):
        # Of equal grams the last, so that repeated lines are picked once.
        best = min(range(j, stops[j]), key=lambda k: (grams[k], -k))
        picked[int(at[best]), grams[best]] = None
        if best != j or gram_end[best] != window_end[j]:
            picked[int(at[j]), xxhash.xxh64_intdigest(h[at[j] : window_end[j]].tobytes()) >> 1] = None
    return [i for i, _ in picked], [x for _, x in picked]


def outlined(noise: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            ids, out = batch.column("doc_id").to_pylist(), ([], [], [], [], [], [])
            for i, body, x in zip(ids, batch.column("body").to_pylist(), batch.column("text").to_pylist()):
                hashes, words = line_hashes(x)
                at, grams = winnowed(hashes, words, noise, least)
                if at:
                    for column, value in zip(out, (i, body, hashes, words, at, grams)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.column("doc_id").type), pa.array(out[1], pa.int64()), *(pa.array(c, pa.list_(pa.int64())) for c in out[2:])], ["doc_id", "body", "hashes", "words", "at", "grams"])

    return run


def extended(least: int):
    """The lines of the later place that matches of two places cover, run by run, where they hold enough words.

    ``hashes`` and ``words`` begin at line ``start`` of the later document,
    ``hashes0`` at line ``start0`` of the earlier one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, bodies, out = batch.column("doc_id").to_pylist(), batch.column("body").to_pylist(), ([], [], [], [])
            for i, body, h, w, h0, start, start0, places in zip(ids, bodies, *(batch.column(c).to_pylist() for c in ("hashes", "words", "hashes0", "start", "start0", "places"))):
                covered: dict[int, int] = {}  # by diagonal, the end of the last run
                for place in sorted(places, key=lambda p: p["at"]):
                    lo = hi = place["at"] - start
                    shift = place["at0"] - start0 - lo
                    if covered.get(shift, 0) > lo:
                        continue
                    while lo > 0 and lo + shift > 0 and h[lo - 1] == h0[lo - 1 + shift]:
                        lo -= 1
                    while hi < len(h) and hi + shift < len(h0) and h[hi] == h0[hi + shift]:
                        hi += 1
                    covered[shift] = hi
                    if sum(w[lo:hi]) >= least:
                        for column, value in zip(out, (i, body, start + lo, start + hi)):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.column("doc_id").type), *(pa.array(c, pa.int64()) for c in out[1:])], ["doc_id", "body", "lo", "hi"])

    return run


def without_repeats(docs: DataFrame, words: int = 50, noise: int = 25, text: str = "text", doc_id: str = "doc_id", prefix: str = "") -> DataFrame:
    """``docs`` with later copies of passages deleted, and n_lines, n_removed, removed.

    A passage is a run of lines with at least ``words`` words that an earlier
    place (by id, then by text, then by line) has too; the earlier place may
    be in the same document.  ``removed`` lists the deleted runs as
    first:end, end exclusive, joined by commas; white space within lines is
    folded for comparison only.  Documents of fewer words, null texts and rows
    without an id stay as they are.  Rows that repeat an id and a text are one
    place: of those, copies are not deleted from each other.  A text of any
    length is read whole; an empty table gives no rows.  Columns keep
    their names; n_lines, n_removed and removed, behind ``prefix``, replace
    columns so called.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = small_arrow(docs).selectExpr(f"`{doc_id}` as doc_id", f"xxhash64(cast(`{text}` as string)) as body", f"cast(`{text}` as string) as text").where("doc_id is not null and text is not null")
    lines = rows.mapInArrow(outlined(noise, words), f"doc_id {kind}, body bigint, hashes array<bigint>, words array<bigint>, at array<bigint>, grams array<bigint>")
    lines = cut(lines.dropDuplicates(["doc_id", "body"]))
    picked = lines.select("doc_id", "body", F.size("hashes").alias("n_here"), F.explode(F.arrays_zip("at", "grams")).alias("p"))
    picked = picked.select(F.col("p.grams").alias("gram"), "doc_id", "body", F.col("p.at").alias("at"), "n_here")
    # A place and the number of its document's lines, which goes with the document.
    first = cut(picked.groupBy("gram").agg(F.min(F.struct("doc_id", "body", "at", "n_here")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    matches = dealt_join(picked, first.select("gram", "first"), first.select("gram", "n"), ["gram"], ["doc_id", "body", "at"])
    matches = matches.where("struct(doc_id, body, at, n_here) > first").withColumn("shift", F.col("first.at") - F.col("at"))
    pairs = matches.groupBy("doc_id", "body", F.col("first.doc_id").alias("doc0"), F.col("first.body").alias("body0")).agg(
        F.collect_list(F.struct("at", F.col("first.at").alias("at0"))).alias("places"),
        *(F.min(c).alias(name) for c, name in (("n_here", "n"), ("first.n_here", "n0"), ("shift", "low"))),
        F.max("shift").alias("high"),
    )
    # Lines of each document that have one on the other side, by the places' shifts: the rest isn't moved.
    reach = {"start": "greatest(0, -high)", "stop": "least(n, n0 - low)", "start0": "greatest(0, low)", "stop0": "least(n0, n + high)"}
    pairs = cut(pairs.selectExpr("doc_id", "body", "doc0", "body0", "places", *(f"cast({x} as int) as {c}" for c, x in reach.items())))
    here = lines.select("doc_id", "body", "hashes", "words")
    there = lines.select(F.col("doc_id").alias("doc0"), F.col("body").alias("body0"), F.col("hashes").alias("hashes0"))
    sliced = (f"slice({c}, start + 1, stop - start) as {c}" for c in ("hashes", "words"))
    near = pairs.join(here, ["doc_id", "body"]).selectExpr("doc_id", "body", "doc0", "body0", "places", "start", "start0", "stop0", *sliced)
    counts = pairs.groupBy("doc0", "body0").agg(F.count(F.lit(1)).alias("n"))
    paired = dealt_join(near, there, counts, ["doc0", "body0"], ["doc_id", "body"])
    paired = paired.selectExpr("doc_id", "body", "hashes", "words", "slice(hashes0, start0 + 1, stop0 - start0) as hashes0", "start", "start0", "places")
    runs = paired.mapInArrow(extended(words), f"doc_id {kind}, body bigint, lo bigint, hi bigint")
    gone = runs.groupBy(F.col("doc_id").alias("__id"), F.col("body").alias("__body")).agg(F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("__gone"))

    names = tuple(prefix + c for c in ("n_lines", "n_removed", "removed"))
    keep = [c for c in docs.columns if c not in names]
    value = F.col(text).cast("string")
    marked = docs.select(*keep, F.col(doc_id).alias("__id"), F.xxhash64(value).alias("__body")).join(cut(gone), ["__id", "__body"], "left")
    lines_of = F.split(value, "\n", -1)
    rest = F.filter(lines_of, lambda _, i: ~F.exists("__gone", lambda g: (i >= g["lo"]) & (i < g["hi"])))
    hit = F.col("__gone").isNotNull()
    marked = marked.withColumn("__rest", F.when(hit, rest)).withColumn("__lines", F.when(value.isNull(), 0).otherwise(F.size(lines_of)))
    return marked.select(
        *(F.when(hit, F.array_join("__rest", "\n")).otherwise(F.col(c)).alias(c) if c == text else F.col(c) for c in keep),
        F.col("__lines").alias(names[0]),
        F.when(hit, F.col("__lines") - F.size("__rest")).otherwise(0).alias(names[1]),
        F.when(hit, F.array_join(F.transform("__gone", lambda g: F.concat_ws(":", g["lo"], g["hi"])), ",")).otherwise("").alias(names[2]),
    )
