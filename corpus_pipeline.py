"""From raw documents to token digests: toxicity, line dedup, near-dedup, decontamination, encoding.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept, and returns the columns of documents; the
last returns the digests of op1. Stages read no table but `docs`, `labels` and `benchmark`.

Rows with a null id are scored, decontaminated and encoded like others; line dedup and near dedup leave them as they are. Rows that
repeat an id are judged each by its own text in all stages but near dedup, where they stay or go together. Null texts stay
null and encode as empty ones; empty tables give an empty result with the same columns.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from assaygrid.llm import decontaminate, line_dedup, near_copies, queries, toxicity
from assaygrid.llm.shared import checkpoint_dir, table

#: SQL cannot express the classifier, XXH64 bits and the tokenizer; tests/llm/test_pipeline.py has brute force.
ORACLE_SQL = None


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars again fits the text."""
    return docs.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else docs


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain does not call toxic."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier line matches."""
    return _measured(line_dedup.dedup(docs))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group linked at five-word Jaccard >= 0.8."""
    return near_copies.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without benchmark passages."""
    blocks = decontaminate.blocks_of(table(spark, sf_dir, "benchmark"))
    return _measured(docs.withColumn("text", decontaminate.clean(F.col("text"), blocks)))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests."""
    return queries.bpe_digests(docs)


STAGES = [("toxicity", without_toxic), ("line_dedup", without_repeated_lines), ("near_dedup", without_near_copies),
          ("benchmark_decontamination", without_benchmark), ("bpe", encoded)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read again."""
    docs, at = table(spark, sf_dir, "documents"), f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
    return docs
