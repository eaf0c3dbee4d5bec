"""The corpus pipeline: its stages in order, each from documents to documents.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again for the next one.
All but the last return the columns of documents; the last returns doc_id, n_pieces and ids.

Rows that repeat stay until near-dedup, which leaves one row of an id. Null and empty texts are scored like others, are
linked with nothing, have no hits, and are encoded to no pieces. Very long texts go through every stage whole. Of equal rows, and of
the members of a group that are alike, the one of the smallest doc_id stays. An empty table goes through as an empty table. Further columns, whatever their
names, are kept by all stages but the last.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from regolith.llm import decontaminate, near_dedup, pieces, quality
from regolith.llm.common import shared_dir


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels of these documents, does not reject."""
    return quality.keep_good(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more."""
    return near_dedup.keep_one(docs, size=5, similar=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each document."""
    return pieces.encode_documents(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("near-dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("sentencepiece", encoding_stage),
]

#: SQL has no zstandard dictionaries; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
    return docs
