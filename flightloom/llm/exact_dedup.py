"""Exact duplicates: local combining, salted groups, then one winner per text (operator 10).

Every stage groups by the digest *and* the whole text, so that texts are only called equal
when their content is. The digest alone is used afterwards, to lead rows back to their
winner, and only once no digest stands for two texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..workload.registry import Registry

REGISTRY = Registry()


def winners(docs: DataFrame, text: str = "text", key: str = "doc_id", salts: int = 64) -> DataFrame:
    """One row per distinct text: ``digest``, ``content``, ``keep_id`` (largest key), ``group_size``.

    Three stages, each on whole content: Spark combines rows of a task before the shuffle,
    groups of (digest, text, salt) meet in ``salts`` places, and their winners, at most ``salts``
    per text, meet last. A text that holds a third of all rows is never in one task.
    """
    rows = docs.select(
        F.col(key).alias("key"),
        F.coalesce(F.col(text), F.lit("")).alias("content"),
    )
    salted = (
        rows.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(salts)).cast("int"))
        .groupBy("content", "salt")
        .agg(F.max("key").alias("salt_winner"), F.count("*").alias("salt_rows"))
    )
    return (
        salted.groupBy(F.sha2("content", 256).alias("digest"), "content")
        .agg(F.max("salt_winner").alias("keep_id"), F.sum("salt_rows").alias("group_size"))
    )


def exact_groups(docs: DataFrame, text: str = "text", key: str = "doc_id", salts: int = 64) -> DataFrame:
    """One row per document: key, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when they are identical; NULL counts as empty. Of equal texts, the row
    with the largest key stays. Rows that repeat a key with the same text are counted one by
    one and all marked as kept. A NULL key is never preferred to another; a group of NULL keys only
    has a NULL ``keep_id`` and keeps its rows. Other columns are not read. An empty table gives no rows.
    """
    best = winners(docs, text, key, salts)
    compact = cut_lineage(best.select("digest", "keep_id", "group_size"))
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("content"))
    rows = rows.withColumn("text_sha256", F.sha2("content", 256))
    if compact.groupBy("digest").count().where("count > 1").isEmpty():
        joined = rows.drop("content").join(compact, F.col("text_sha256") == F.col("digest"))
    else:  # two texts with one digest: the texts themselves lead to the winner
        joined = rows.join(best, "content")
    return joined.select(
        F.col("key").alias(key),
        "keep_id",
        "group_size",
        F.col("key").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def drop_exact(docs: DataFrame, text: str = "text", key: str = "doc_id", salts: int = 64) -> DataFrame:
    """The documents that stay, with all their columns.

    Rows that repeat both the key and the text of a winner stay once; documents without a key stay.
    """
    keep = winners(docs, text, key, salts).select(F.col("keep_id").alias("__keep"), F.col("digest").alias("__digest"))
    alone = docs.where(F.col(key).isNull())
    keyed = docs.where(F.col(key).isNotNull()).withColumn("__own", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    kept = keyed.join(
        keep.where("__keep IS NOT NULL"), (F.col(key) == F.col("__keep")) & (F.col("__own") == F.col("__digest")), "left_semi"
    )
    if not keyed.groupBy(key).count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates([key, "__own"])
    return kept.drop("__own").unionByName(alone)


@REGISTRY.add(
    "op10_exact_dedup",
    """
    WITH t AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, coalesce(text, '') AS content FROM documents)
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, text_sha256
    FROM t WINDOW w AS (PARTITION BY content)
    """,
)
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
