"""The corpus pipeline: five stages, each written as a table and read again by the next.

Toxic documents go, of equal texts one stays, of near duplicates one stays, personal data is masked, and what is left is packed
into token sequences. All stages but the last take and return documents (doc_id, text, lang, source, n_chars); the last
returns the pieces of the packed sequences. A stage works on all rows that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightloom.llm import exact_dedup, near_dedup, packing, pii, toxicity
from flightloom.session import cut_lineage, tune


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the noisy-or model of operator 4 scores 0.3 or more go."""
    return toxicity.drop_toxic(docs, tune(spark).read.parquet(f"{sf_dir}/labels.parquet"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest doc_id stays (operator 10)."""
    tune(spark)
    return exact_dedup.drop_exact(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 on five-word shingles, the smallest doc_id stays (operator 9)."""
    tune(spark)
    return near_dedup.drop_near(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of operator 7 are replaced by their kind; n_chars follows the text."""
    tune(spark)
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 tokens, with their ids (operator 3)."""
    import public_tokenizers  # the vocabulary is needed by this stage only

    tune(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxic),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("pii", personal_data),
    ("packing", packed),
]

#: Trained models, linked components and packing can't be said in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; tables between stages are in the shared folder."""
    docs = tune(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
