"""A corpus pipeline: toxic documents go, repeated passages go, one document of each near-duplicate group stays, personal data is masked, and what is left is packed."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import linededup, packing, pii, simhash, toxicity
from docloom.llm.common import remove, scratch, table
from docloom.session import ship


def _like(docs: DataFrame, of: DataFrame) -> DataFrame:
    """``docs`` with the columns of ``of``; n_chars, where there is one, follows the text."""
    if "n_chars" in of.columns:
        docs = docs.withColumn("n_chars", F.char_length("text").cast(of.schema["n_chars"].dataType))
    return docs.select(*of.columns)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose chance of being toxic is below ``toxicity.THRESHOLD``, by a chain fitted on ``labels``.

    Null texts are scored as empty ones; rows without an id and repeated rows
    are scored each; an empty table stays empty, and without labels all stay.
    """
    chain = toxicity.train(docs, table(spark, sf_dir, "labels"), toxicity.CATEGORIES)
    return toxicity.scored(docs, chain, prefix="__p_").where(F.col("__p_toxic") < toxicity.THRESHOLD).select(*docs.columns)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of passages of 50 words and more are deleted; a document of which nothing is left goes."""
    rows = linededup.without_repeats(docs, words=50, prefix="__")
    return _like(rows.where((F.col("__n_removed") == 0) | (F.trim("text") != "")), docs)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of SimHash near-duplicates (shingles of five words, a similarity of 0.8), the row with the smallest id stays; so do rows without an id."""
    groups = simhash.similar_groups(docs, words=5, similarity=0.8)
    first = groups.where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.unionByName(docs.where("doc_id is null")).select(*docs.columns)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are masked; every row stays, null texts as they are."""
    return _like(pii.redacted(docs), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens, in pieces; null texts are empty, repeated rows are packed each, an empty table gives no rows."""
    rows = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), window=1024)
    return rows.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("line dedup", without_repeated_lines),
    ("near-duplicates", without_near_duplicates),
    ("personal data", without_personal_data),
    ("packing", packed),
]

#: Fitted models and packing have no SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again in the shared folder.

    A stage's table goes when the next one is written, the last when the
    session ends.
    """
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    at = scratch(spark, "corpus")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
        if k:
            remove(spark, f"{at}/{k - 1}")
    return docs
