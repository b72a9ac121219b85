"""A corpus pipeline: quality filter, exact and near deduplication, removal of secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs.  Between
stages the rows are written as Parquet and read again.  Nulls, empty texts, repeated rows and empty tables are
defined by the operators; rows that can't be told apart (same id, same text) count as one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sievemill.llm import boosting, exact, jaccard, packing, secrets
from sievemill.llm.common import written

#: SQL can't express the classifiers and the packing.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = boosting.train(docs, boosting.labels(spark, sf_dir))
    scored = boosting.score_quality(docs, model)
    return scored.where("predicted = 1").select(docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for blanks."""
    return exact.keep_rows(docs, exact.exact_groups(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, texts whose five-word shingles have a Jaccard similarity of 0.8 or
    more: that with the smallest id (null last).  SimHash fingerprints and their deletion variants link first; pairs
    whose fingerprints differ in more bits are found by shared shingles."""
    return exact.keep_rows(docs, jaccard.near_duplicates(docs))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret in the text; n_chars follows."""
    found = secrets.scan_secrets(docs, secrets.train(), path="source", masked="text")
    changed = F.exists("findings", lambda f: f["secret"])
    return found.withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars"))).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their bins."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality", quality),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mask_secrets", mask_secrets),
    ("pack", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
