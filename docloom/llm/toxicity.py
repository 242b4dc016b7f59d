"""Toxicity by a chain of linear classifiers.

Categories are predicted in order.  Each is a logistic regression over the
words of a text, over the beginnings of its longer words (which the forms of
one word share), and over the log-odds that the chain has given the text for
the categories before it.  For training, those log-odds are out-of-fold: each
labelled row gets them from models that were fitted without it, so that later
models see earlier predictions as good as they will be on new texts.

Models are fitted on the driver over a bounded sample of labelled rows
(``max_labelled`` and ``max_bytes``, taken in the order of a hash of the id);
all documents are scored, whole, where they are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import cut, small_arrow, small_batches

WORDS = re.compile(r"\w+").findall
#: Lengths of the beginnings that count as features of longer words.
BEGINNINGS = (4, 5)
#: A feature is used if this many labelled texts have it.
LEAST_DOCS = 3
#: Features of a category: those whose presence tells most about it.
FEATURES = 1500
FOLDS = 5
CLIP = 8.0

#: The labels' categories, in the order of the chain.
CATEGORIES = {"low_quality": "quality = 0", "toxic": "toxic = 1"}
#: Documents are toxic from this probability on.
THRESHOLD = 1 / 3


def words_of(text: str) -> set[str]:
    return set(WORDS(text.lower()))


def features_of(words: Iterable[str]) -> set[str]:
    """Words, and the beginnings of longer ones with a star."""
    out = set(words)
    for k in BEGINNINGS:
        out |= {w[:k] + "*" for w in words if len(w) > k}
    return out


@dataclass
class Linear:
    """Logistic regression over the presence of features and over a few numbers."""

    bias: float
    weights: dict[str, float]
    numbers: list[float]

    def log_odds(self, features: set[str], numbers: list[float]) -> float:
        score = self.bias + sum(self.weights[f] for f in features & self.weights.keys()) + sum(a * b for a, b in zip(self.numbers, numbers))
        return min(CLIP, max(-CLIP, score))


@dataclass
class Chain:
    categories: list[str]
    models: list[Linear] = field(default_factory=list)

    def log_odds(self, text: str) -> list[float]:
        features, out = features_of(words_of(text)), []
        for model in self.models:
            out.append(model.log_odds(features, out))
        return out


@dataclass
class Sample:
    """Labelled texts: the feature (a number) of each pair of a text and a feature that it has."""

    names: list[str]
    rows: np.ndarray
    cols: np.ndarray
    n: int

    @classmethod
    def of(cls, texts: Iterable[Iterable[str]]) -> Sample:
        place: dict[str, int] = {}
        cols, sizes = [], []
        for words in texts:
            own = np.fromiter((place.setdefault(f, len(place)) for f in features_of(words)), dtype=np.int32)
            cols.append(own)
            sizes.append(len(own))
        rows = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        return cls(list(place), rows, np.concatenate(cols) if cols else np.zeros(0, np.int32), len(sizes))


def telling(sample: Sample, used: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Features by the log-likelihood ratio of their presence and the category, over the texts ``used``; ties by name."""
    d = len(sample.names)
    mine = used[sample.rows]
    k = np.bincount(sample.cols[mine], minlength=d).astype(float)
    a = np.bincount(sample.cols[mine], y[sample.rows[mine]], minlength=d)
    frequent = np.flatnonzero(k >= LEAST_DOCS)
    n, p = float(used.sum()), float(y[used].sum())
    k, a = k[frequent], a[frequent]
    table = np.stack([a, k - a, p - a, n - p - k + a])
    expected = np.stack([k * p, k * (n - p), (n - k) * p, (n - k) * (n - p)]) / max(n, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(table > 0, table * np.log(table / expected), 0).sum(axis=0)
    candidates = np.argsort(-gain, kind="stable")[: 2 * FEATURES]
    best = sorted(candidates, key=lambda i: (-round(gain[i], 9), sample.names[frequent[i]]))[:FEATURES]
    return frequent[np.array(best, dtype=np.int64)]


def fitted(sample: Sample, numbers: np.ndarray, y: np.ndarray, used: np.ndarray, penalty: float = 0.3, steps: int = 120) -> tuple[Linear, np.ndarray]:
    """Logistic regression over the texts ``used`` with an L2 penalty, by accelerated gradient steps; and the log-odds of all texts."""
    chosen = telling(sample, used, y)
    d, m, n = len(chosen), numbers.shape[1], sample.n
    slot = np.full(len(sample.names), -1)
    slot[chosen] = np.arange(d)
    here = slot[sample.cols] >= 0
    all_rows, all_cols = sample.rows[here], slot[sample.cols[here]]
    mine = used[all_rows]
    rows, cols = all_rows[mine], all_cols[mine]
    # Both classes weigh alike.
    share = min(max(y[used].mean() if used.any() else 0.5, 1e-3), 1 - 1e-3)
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)) * used
    # A column's step follows from how many rows have it.
    seen = np.bincount(cols, weight[rows], d)
    scale = np.concatenate([1 / (0.25 * seen + penalty), 1 / (0.25 * (weight @ numbers**2) + penalty), [1 / (0.25 * weight.sum() + 1e-9)]])
    widest = max(1.0, len(rows) / max(1, used.sum()) + m + 1)
    w = np.zeros(d + m + 1)
    ahead, t = w.copy(), 1.0
    for _ in range(steps):
        z = np.bincount(rows, ahead[cols], n) + numbers @ ahead[d : d + m] + ahead[-1]
        error = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        slope = np.concatenate([np.bincount(cols, error[rows], d), numbers.T @ error, [error.sum()]])
        slope[:-1] += penalty * ahead[:-1]
        new = ahead - scale / widest * slope
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead, w = new + (before - 1) / t * (new - w), new
    # Back from equal classes to their shares in the sample.
    bias = float(w[-1] + np.log(share / (1 - share)))
    odds = np.clip(np.bincount(all_rows, w[all_cols], n) + numbers @ w[d : d + m] + bias, -CLIP, CLIP)
    weights = {sample.names[chosen[i]]: float(w[i]) for i in np.flatnonzero(np.abs(w[:d]) > 1e-6)}
    return Linear(bias, weights, [float(x) for x in w[d : d + m]]), odds


def fit_chain(sample: Sample, labels: np.ndarray, categories: list[str], folds: np.ndarray) -> Chain:
    """A chain over ``labels`` (one column for each category), with out-of-fold log-odds between its links."""
    chain = Chain(categories)
    numbers, everything = np.zeros((sample.n, 0)), np.ones(sample.n, dtype=bool)
    for k in range(len(categories)):
        y = labels[:, k].astype(float)
        outside = np.zeros(sample.n)
        if k + 1 < len(categories):
            for fold in range(FOLDS):
                left = folds == fold
                outside[left] = fitted(sample, numbers, y, ~left)[1][left]
        chain.models.append(fitted(sample, numbers, y, everything)[0])
        numbers = np.column_stack([numbers, outside])
    return chain


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, str], max_labelled: int = 8000, max_bytes: int = 256 << 20, text: str = "text", doc_id: str = "doc_id") -> Chain:
    """A chain for ``categories``: names to SQL conditions over ``labels``, in the order of the chain.

    At most ``max_labelled`` ids of ``labels`` are used, the first by a hash
    of the id.  Only the distinct words of their texts come to the driver, and
    of those ``max_bytes`` at most: ids whose words would go beyond it, in that
    same order, are left out.  Of an id that several rows of ``labels`` name,
    the smallest conditions count; of several rows of ``docs``, the one with
    the smallest hash of its text.  Rows whose conditions or ids are null are
    left out; null texts count as empty.  The ``FEATURES`` most telling features
    of at least ``LEAST_DOCS`` labelled texts are used, ties by name.  Without
    labelled texts the chain gives every text log-odds of 0.
    """
    names = [f"c{k}" for k in range(len(categories))]
    chosen = labels.select(F.col(doc_id).alias("doc_id"), *(F.expr(c).cast("int").alias(n) for n, c in zip(names, categories.values()))).dropna()
    chosen = chosen.groupBy("doc_id").agg(*(F.min(n).alias(n) for n in names)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = small_arrow(docs).select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    kind, kinds = docs.schema[doc_id].dataType.simpleString(), ", ".join(f"{c} int" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            words = pa.array([sorted(words_of(x)) for x in batch.column("text").to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "body", *names)), words], ["doc_id", "body", *names, "words"])

    found = rows.select("doc_id", F.xxhash64("text").alias("body"), *names, "text").mapInArrow(run, f"doc_id {kind}, body bigint, {kinds}, words array<string>")
    # An id's rows are combined before the shuffle, so that none is too many for a task.
    found = cut(found.groupBy("doc_id").agg(F.min_by(F.struct(*names, "words"), "body").alias("x")).select("doc_id", "x.*"))
    held = found.select("doc_id", F.aggregate("words", F.lit(0).cast("long"), lambda n, w: n + F.octet_length(w) + 8).alias("held"))
    within = held.selectExpr("doc_id", "sum(held) over (order by xxhash64(doc_id), doc_id) as upto").where(F.col("upto") <= max_bytes).select("doc_id")
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int").alias("fold")
    got = found.join(F.broadcast(within), "doc_id").select(fold, *names, "words").toArrow()
    if not got.num_rows:
        return Chain(list(categories), [Linear(0.0, {}, [0.0] * k) for k in range(len(categories))])
    sample = Sample.of(x.as_py() for x in got.column("words"))
    values = np.column_stack([got.column(c).to_numpy() for c in names])
    return fit_chain(sample, values, list(categories), got.column("fold").to_numpy())


def scored(docs: DataFrame, chain: Chain, text: str = "text", prefix: str = "p_") -> DataFrame:
    """``docs`` with ``prefix`` and name of each category of ``chain`` as columns.

    A null text counts as empty, and a text of any length is read whole.  All
    columns are kept, repeated rows and rows without an id too; columns of
    those names are replaced; an empty table gives no rows.
    """
    names = [f"{prefix}{c}" for c in chain.categories]
    rows = small_arrow(docs).drop(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, by=text):
            odds = np.array([chain.log_odds(x or "") for x in batch.column(text).to_pylist()]).reshape(-1, len(names))
            p = 1 / (1 + np.exp(-odds))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(p[:, k]) for k in range(len(names)))], [*batch.schema.names, *names])

    schema = StructType([*rows.schema.fields, *(StructField(n, DoubleType()) for n in names)])
    return rows.mapInArrow(run, schema)
