"""Cells of candidates: rows that share a key and are compared with each other.

A cell may hold any number of rows.  Cells are counted first; rows alone in
theirs go away, and a cell beyond ``chunk`` rows is dealt into chunks, whose
pairs become groups of at most two chunks, so that no task gets a whole large
cell.  No pair is emitted here: each group is compared inside its task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 4096


def dealt_cells(rows: DataFrame, cell: str, member: str, chunk: int = CHUNK, weight: Column | None = None, most: int = 0) -> DataFrame:
    """``rows`` with (i, j, side), sorted by (cell, i, j, side, member) within partitions.

    Within a group (cell, i, j), rows of side 0 are compared with those of
    side 1, or with each other where i = j.  Every two rows of a cell meet in
    exactly one group.  With ``weight``, chunks also hold about ``most`` of it.
    """
    full = F.count(F.lit(1)) / F.lit(chunk)
    full = full if weight is None else F.greatest(full, F.sum(weight) / F.lit(most))
    sizes = rows.groupBy(cell).agg(F.count(F.lit(1)).alias("n_cell"), full.alias("full")).where("n_cell > 1").drop("n_cell")
    many = F.ceil("full").cast("int")
    own = F.pmod(F.xxhash64(member), F.col("chunks")).cast("int")
    dealt = rows.join(sizes, cell).withColumn("chunks", many).withColumn("own", own)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select(*rows.columns, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    return dealt.repartition(cell, "i", "j").sortWithinPartitions(cell, "i", "j", "side", member)
