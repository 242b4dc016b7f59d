"""What a query has cost: rows, bytes and time, from Spark's own counters."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Metrics:
    """``documents`` come out, ``examined`` rows are read from ``files`` files that have ``bytes`` bytes together."""

    documents: int
    seconds: float
    examined: int
    files: int
    bytes: int

    def as_reply(self) -> dict:
        return {"nReturned": self.documents, "executionTimeMillis": round(1000 * self.seconds), "totalDocsExamined": self.examined, "filesExamined": self.files, "bytesExamined": self.bytes}


def measured(df: DataFrame) -> Metrics:
    """Runs a query, without bringing its rows anywhere, and says what it took.

    ``bytes`` are those of the files that the scan opens, after partition
    pruning; columns that aren't read are counted with their files.
    """
    execution = df._jdf.queryExecution()
    began = time.perf_counter()
    documents = execution.toRdd().count()
    seconds = time.perf_counter() - began
    found = {"numOutputRows": 0, "numFiles": 0, "filesSize": 0}
    for leaf in _leaves(execution.executedPlan()):
        for name in found:
            counter = leaf.metrics().get(name)
            found[name] += counter.get().value() if counter.isDefined() else 0
    return Metrics(documents, seconds, found["numOutputRows"], found["numFiles"], found["filesSize"])


def _leaves(node) -> list:
    """Leaves of a plan that has run; a reused exchange was read once and is left out."""
    kind = node.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return _leaves(node.executedPlan())
    if kind.endswith("QueryStageExec"):
        return _leaves(node.plan())
    if kind == "ReusedExchangeExec":
        return []
    inner = node.children()
    return [x for k in range(inner.size()) for x in _leaves(inner.apply(k))] if inner.size() else [node]
