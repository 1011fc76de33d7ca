"""A training-data pipeline over `documents`: quality, near-duplicates, PII, mixture, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chirpsieve.llm import mixing, packing, pii, quality, simhash
from chirpsieve.llm.common import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier (op 4) doesn't reject: score of 0.7 or more, rows as they are.

    Null and empty texts are scored like others; repeated rows share their
    score; without labels all score 0.5 and go; an empty table stays empty.
    """
    scored = quality.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), COLUMNS)
    return scored.where(F.col("score") >= quality.THRESHOLD).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group (op 3): five-word shingles, Jaccard of 0.8 or more.

    The smallest (doc_id, text keys) stays, null ids last. Texts without words
    (null, empty) are one group, repeated rows one row; long texts are compared
    whole; an empty table stays empty.
    """
    return simhash.dedup(docs.select(*COLUMNS))


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Surrogates for personal data and secrets (op 10); n_chars follows the new text.

    Every row stays; null and empty texts as they are (0 characters), equal
    texts get equal ones; an empty table stays empty.
    """
    out = pii.pseudonymise(docs.select(*COLUMNS), pii.session_key(spark))
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture (op 1) as documents: a row for each pass over a document, with the words taken.

    A null source is a source of its own; texts without words are in no pass;
    rows equal in doc_id, source and text take the same words; an empty table
    stays empty.
    """
    return mixing.mixed_texts(docs.select(*COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of full sequences (op 8): each row is a document, whatever its id; without rows no pieces."""
    return packing.pack(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("private", replace_private),
    ("mixture", mix_sources),
    ("packing", pack_sequences),
]
# Classifier, hashing and tokeniser are beyond SQL; tests/llm compares stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; between stages documents are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs)
    return docs
