"""The corpus pipeline: quality rules, toxicity, near-duplicates, mixing, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from dwell.llm import mixture, quality, queries, simhash, toxicity
from dwell.sources.storage import fresh_folder


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that pass the quality rules."""
    queries.ship(spark)
    return quality.keep_good(docs)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that are not toxic; labels of held-out documents are not read."""
    queries.ship(spark)
    machine = toxicity.fit_toxicity(docs, queries.learnable_labels(spark, sf_dir))
    return toxicity.drop_toxic(docs, machine)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group: the one with the smallest id, if any has one."""
    queries.ship(spark)
    return simhash.keep_first(docs)


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or drop documents so that sources come near their targets."""
    return mixture.repeat_documents(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the text decoded from them."""
    queries.ship(spark)
    return queries.encode_digests(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("toxicity", toxicity_stage),
    ("near-duplicates", near_duplicate_stage),
    ("mixture", mixture_stage),
    ("encoding", encoding_stage),
]

# Toxicity and encoding are not expressible in SQL; the tests run a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = fresh_folder(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if i + 1 == len(STAGES):
            return made
        made.write.parquet(f"{folder}/{i}")
        docs = spark.read.schema(made.schema).parquet(f"{folder}/{i}")
    return docs
