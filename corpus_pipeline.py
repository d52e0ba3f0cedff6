"""A corpus pipeline of five of the operators: each stage works on what the one before kept.

run() applies the stages to documents and returns the packed sequences. A stage's result is written as Parquet to the shared
work folder and read again, so that no stage is computed twice and the loss of an executor costs its running tasks only.
SQL can't express the stages (segments scored by a fitted model, alignment, tests, greedy packing): ORACLE_SQL is None, and
the tests hold each stage against planted cases and, for packing, the counts of its input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tempograph.llm import near_dedup, packing, secret_scan, substring_dedup, toxicity
from tempograph.llm.common import Work, read


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go; the model is fitted on the labelled ones."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the smallest doc_id stays."""
    return near_dedup.keep_first(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of 30 words or more that occur earlier in the corpus are cut out."""
    return substring_dedup.drop_repeats(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    return secret_scan.redact(docs, secret_scan.model(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of a fixed capacity with balanced cost."""
    return packing.pack(docs)


STAGES = [("toxicity", toxic), ("near copies", near), ("repeated lines", repeats), ("secrets", secrets), ("packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work, docs = Work(spark, "pipeline"), read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = work.cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
