"""Canonical exact digests of documents (DataFrame functions only).

A text is normalised to NFKC, case-folded and normalised again (folding takes
some characters apart), its runs of white space become one space and its ends
are trimmed.  The digest is 128 bits wide: xxHash64 of the
canonical text, twice, the second time behind a prefix.  Documents are grouped
by digest, and inside a bucket the canonical bytes themselves are compared, so
that a collision never merges different texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space in a canonical text: what Unicode calls so, after NFKC.
SPACE = r"[\s\p{Z}\x{85}]+"
#: Bits of an id within its block of documents, and of a block within its block of blocks.
LOW_BITS, UP_BITS, LEVELS = 6, 16, 3


def canonical(text: Column) -> Column:
    """The canonical form of ``text``; null counts as empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    nfkc = lambda x: F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(True))
    folded = F.java_method(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), nfkc(text), F.lit(True))
    return F.trim(F.regexp_replace(nfkc(folded), SPACE, " "))


def digest(canon: Column) -> Column:
    """32 hexadecimal digits of 128 bits of xxHash64."""
    halves = (F.xxhash64(canon), F.xxhash64(F.lit("docloom"), canon))
    return F.lower(F.concat(*(F.lpad(F.hex(h), 16, "0") for h in halves)))


def fingerprint_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each class of equal canonical texts.

    Returns (fingerprint, check, group_id, group_size): ``group_id`` is the
    smallest id, ``check`` the SHA-256 of the canonical text, which tells
    classes apart that share a fingerprint.  Rows are combined before the
    shuffle, so that a class of any size is one row of each task, and equal
    hashes are followed by a comparison of the bytes (the canonical text is
    part of the key).  Null texts and empty ones are one class; an empty
    table gives no rows; columns other than the two named are not read.
    """
    rows = docs.select(F.col(doc_id).alias("id"), canonical(F.col(text)).alias("canon"))
    rows = rows.select("id", "canon", digest(F.col("canon")).alias("fingerprint"))
    classes = rows.groupBy("fingerprint", "canon").agg(F.min("id").alias("group_id"), F.count(F.lit(1)).alias("group_size"))
    return classes.select("fingerprint", F.sha2("canon", 256).alias("check"), "group_id", "group_size")


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with fingerprint, group_id and group_size.

    Repeated rows stay repeated.  New columns replace columns of those names.
    """
    names = ("fingerprint", "check", "group_id", "group_size")
    keep = [c for c in docs.columns if c not in names]
    rows = docs.select(*keep, canonical(F.col(text)).alias("__canon"))
    rows = rows.withColumn("fingerprint", digest(F.col("__canon"))).withColumn("check", F.sha2("__canon", 256)).drop("__canon")
    return rows.join(fingerprint_groups(docs, text, doc_id), ["fingerprint", "check"]).drop("check")


def with_next_text(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, text, next_text): the text of the next id, ascending; after the last, of the first.

    Ids fall into blocks of 64 consecutive values; a window inside each
    block finds all followers but the last row's, which is the first row of
    the next block in use.  That is found in the same way over the blocks'
    first rows, level by level, so that no task sees more than a block and
    texts are shuffled once.  Rows of one id follow each other by text; rows
    without an id have an empty follower.  Ids are whole numbers; others raise.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    known = rows.where("doc_id is not null").withColumn("block", F.shiftright("doc_id", LOW_BITS))
    inner = known.selectExpr("*", "lead(text) over (partition by block order by doc_id, text) as next_text")
    # Heads of blocks: the block, and the text of its first row.
    heads = known.groupBy("block").agg(F.min(F.struct("doc_id", "text"))["text"].alias("head"))
    follow = next_value(known.select("block").distinct(), "block", levels=LEVELS)
    heads = follow.join(heads.withColumnRenamed("block", "next"), "next").select("block", "head")
    out = inner.join(heads, "block", "left").select("doc_id", "text", F.coalesce("next_text", "head").alias("next_text"))
    lost = rows.where("doc_id is null").select("doc_id", "text", F.lit("").alias("next_text"))
    return out.unionByName(lost)


def next_value(values: DataFrame, name: str, levels: int) -> DataFrame:
    """(name, next) for distinct whole numbers: the next larger one, or the smallest after the largest.

    Values are cut into blocks of 65536; followers across blocks come from the
    blocks' smallest values, found by calling this again over the blocks.  The
    last level has the few values that 64 bits leave.
    """
    values = values.select(F.col(name).alias("v"))
    if levels == 0:
        return values.selectExpr(f"v as {name}", "coalesce(lead(v) over (order by v), min(v) over ()) as next")
    blocks = values.withColumn("up", F.shiftright("v", UP_BITS))
    inside = blocks.selectExpr("v", "up", "lead(v) over (partition by up order by v) as next")
    firsts = blocks.groupBy("up").agg(F.min("v").alias("first"))
    after = next_value(firsts, "up", levels - 1)
    across = after.join(firsts.withColumnRenamed("up", "next"), "next").select("up", "first")
    return inside.join(across, "up").select(F.col("v").alias(name), F.coalesce("next", "first").alias("next"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of ``docs`` and of each text with its last quarter exchanged.

    The last floor(n/4) code points give way to the first as many (or all) of
    the next document.  Likeness of two exact digests is 1 where they agree
    and 0 elsewhere.  Null texts count as empty; a text of any length is read
    whole.  Rows that repeat an id follow each other by text, and each comes
    back; rows without an id have an empty follower.  Ids are whole numbers;
    others raise.  An empty table gives no rows; other columns are not read.
    """
    rows = with_next_text(docs)
    n = F.char_length("text")
    k = F.floor(n / 4).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - k), F.substring(F.col("next_text"), F.lit(1), k)))
    rows = rows.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        canonical(F.col("text")).alias("canon"),
        canonical(F.col("edited")).alias("canon_edited"),
        canonical(F.col("next_text")).alias("canon_next"),
    )
    rows = rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        digest(F.col("canon")).alias("fingerprint"),
        digest(F.col("canon_edited")).alias("edited_fingerprint"),
        F.sha2("canon", 256).alias("check"),
        (F.col("canon") == F.col("canon_edited")).cast("double").alias("near_edited"),
        (F.col("canon") == F.col("canon_next")).cast("double").alias("near_next"),
    )
    return rows.join(fingerprint_groups(docs), ["fingerprint", "check"]).drop("check")
