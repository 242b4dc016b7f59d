"""Connected components of a graph whose edges are rows.

Randomised contraction: in each round a node moves to the neighbour (or
itself) with the smallest hash for that round, and edges are rewritten to the
nodes they moved to.  The expected number of nodes falls by a constant factor
in each round, whatever the graph's shape, so that chains need as few rounds
as stars do.  Every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, scratch, written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row (node, root) for each node with an edge to another node.

    Nodes of one component share ``root``, one of its nodes.  Edges with a
    null end, loops and repeated edges are allowed and change nothing; no
    edges give no rows.
    """
    spark = edges.sparkSession
    at = scratch(spark, "components")
    live = written(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), f"{at}/live-0")
    moves: list[DataFrame] = []
    while not live.isEmpty():
        k = len(moves)
        seed = F.lit(k)
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b", seed).alias("h"), F.col("b").alias("v"))).alias("m"))
        own = F.struct(F.xxhash64("a", seed).alias("h"), F.col("a").alias("v"))
        move = written(best.select(F.col("a").alias("node"), F.least(F.col("m"), own)["v"].alias("root")), f"{at}/move-{k}")
        moves.append(move)
        to_a = move.select(F.col("node").alias("a"), F.col("root").alias("x"))
        to_b = move.select(F.col("node").alias("b"), F.col("root").alias("y"))
        moved = live.join(to_a, "a").join(to_b, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        live = written(moved, f"{at}/live-{k + 1}")
        remove(spark, f"{at}/live-{k}")
    if not moves:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    # From the last and smallest round back, so that each round's nodes are moved once.
    out = moves.pop()
    for earlier in reversed(moves):
        step = out.select(F.col("node").alias("root"), F.col("root").alias("next"))
        out = earlier.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return out
