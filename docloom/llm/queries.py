"""The operators of this subpackage over the standard tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fingerprints, linededup, packing, pii, sharding, simhash, toxicity, vectors, warc
from .common import table

TOKENIZER = "byte_bpe_50k.json"


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoding_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.simhash_groups(table(spark, sf_dir, "documents"), words=4)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.9)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, p_low_quality, p_toxic, toxic): all documents, by a chain fitted on the labels."""
    docs = table(spark, sf_dir, "documents")
    chain = toxicity.train(docs, table(spark, sf_dir, "labels"), toxicity.CATEGORIES)
    rows = toxicity.scored(docs.select("doc_id", "text"), chain).drop("text")
    return rows.withColumn("toxic", F.col("p_toxic") >= toxicity.THRESHOLD)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), window=1024, end_id=0)
    return rows.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_digests(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, n_lines, n_removed, removed): all documents without later copies of passages."""
    return linededup.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), words=50)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"), shards=16)


QUERIES = {f.__name__: f for f in (op1_fingerprints, op2_bpe, op3_simhash, op4_embeddings, op5_toxicity, op6_packing, op7_pii, op8_line_dedup, op9_warc, op10_sharding)}

# SQL for those that DuckDB can express over whole tables; the tests compare
# the others with brute force.
ORACLE_SQL = {
    "op4_embeddings": """
        WITH RECURSIVE e AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
        ), p AS (
            SELECT a.vec_id AS i, b.vec_id AS j FROM e AS a JOIN e AS b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.9
        ), reach AS (
            SELECT vec_id AS i, vec_id AS r FROM e UNION SELECT reach.i, p.j FROM reach JOIN p ON reach.r = p.i
        )
        SELECT e.vec_id, (SELECT COUNT(*) FROM p WHERE p.i = e.vec_id) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
        FROM e JOIN (SELECT i, MIN(r) AS component_id FROM reach GROUP BY i) AS c ON c.i = e.vec_id
    """,
    "op9_warc": """
        WITH p AS (
            SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
        ), f AS (
            SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
        FROM f
    """,
}
