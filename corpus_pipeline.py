"""A training-data pipeline over `documents`: STAGES in order, each on the Parquet that its predecessor wrote.

language: documents of no known language go. near_duplicates: of each component of near copies the smallest doc_id
stays. decontamination: documents that leak a benchmark item go. mixing: sources are cut to half of the tokens by the
tree's weights, in one epoch, so no document is repeated. tokens: the kept documents as token-id files, and what is in them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from twinframe.llm import decontamination, language, mixing, simhash, tokens
from twinframe.llm.common import cut

#: rows that Spark hands to a Python worker at a time: documents are long, and executors hold two such batches a task
ARROW_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """For the session that runs the pipeline: the first stage sets it for all."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return language.keep_known(docs)


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def stage_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, mixing.tree(docs.source, docs.lang), share=mixing.PIPELINE_SHARE, max_epochs=1)


def stage_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokens.token_output(docs)


STAGES = [("language", stage_language), ("near_duplicates", stage_near_duplicates), ("decontamination", stage_decontamination), ("mixing", stage_mixing), ("tokens", stage_tokens)]

#: SQL can express neither the language model nor the tokenizer; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
