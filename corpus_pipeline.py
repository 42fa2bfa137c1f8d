"""The corpus pipeline: quality classifier, exact and near deduplication, PII
masking, packing. Each stage reads what its predecessor wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from surveylens.llm import exact, near, packing, pii, resampling
from surveylens.session import ensure_checkpoint_dir

NEAR = 0.8


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling rejects go."""
    return resampling.keep_sampled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays, the one with the largest id."""
    return exact.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (a Jaccard similarity of
    ``NEAR`` or more) stays, the one with the smallest id."""
    return near.keep_one(docs, threshold=NEAR)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data is replaced by its kind; ``n_chars`` follows."""
    return pii.masked_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, with their place in a sequence."""
    return packing.pack_documents(docs, added_tokens=True)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("personal data", pii_stage),
    ("best-fit packing", packing_stage),
]

#: Trained models and similarity groups cannot be stated in SQL; tests hold the
#: pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every result is written as Parquet to the
    shared checkpoint folder and read again as the next stage's input."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
