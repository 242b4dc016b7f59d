"""Paging over a result."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

from pyspark.sql import DataFrame


class Cursor:
    """Documents of a lazy result, batch by batch.

    Rows are fetched one partition at a time, so that the driver holds no
    more than a partition.
    """

    _ids = itertools.count(1)

    def __init__(self, df: DataFrame, namespace: str = "", batch_size: int = 101) -> None:
        self.df, self.namespace, self.batch_size = df, namespace, batch_size
        self.id = next(self._ids)
        self._rows: Iterator | None = None
        self.exhausted = False

    def next_batch(self, n: int | None = None) -> list[dict]:
        """The next ``n`` documents, or fewer at the end; fields that are null are left out."""
        if self.exhausted:
            return []
        if self._rows is None:
            self._rows = self.df.toLocalIterator()
        n = abs(n or self.batch_size)
        out = [document(r) for r in itertools.islice(self._rows, n)]
        if len(out) < n:
            self.close()
        return out

    def close(self) -> None:
        self._rows, self.exhausted = None, True

    def __iter__(self) -> Iterator[dict]:
        while batch := self.next_batch():
            yield from batch


def document(row) -> dict:
    """A row as a document, without its nulls."""
    return {k: v for k, v in row.asDict(recursive=True).items() if v is not None}
