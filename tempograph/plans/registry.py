"""Registration of queries, and the adapters from the driver's tables to the logical ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The driver's tables by name, and the logical tables derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def messages(self) -> DataFrame:
        """conversation, position, role, content, revision, message."""
        return self.conversations.select(F.col("conv_id").alias("conversation"), F.col("turn").alias("position"), "role", F.col("text").alias("content"), F.sha2("text", 256).alias("revision"), (F.col("conv_id") * 1000 + F.col("turn")).alias("message"))

    def replies(self) -> DataFrame:
        c = self.conversations.where("turn > 0")
        return c.select(F.col("conv_id").alias("conversation"), (F.col("conv_id") * 1000 + F.col("turn")).alias("from_message"), (F.col("conv_id") * 1000 + F.col("turn") - 1).alias("to_message"))

    def observed(self) -> DataFrame:
        """Symbol observations: logical = source, revision = digest of the text, path = lang, seq = doc_id."""
        return self.documents.select(F.col("doc_id").alias("seq"), F.col("source").alias("logical"), F.sha2("text", 256).alias("revision"), F.col("lang").alias("path"))


def query(sql: str | None = None, name: str | None = None):
    def add(f: Callable[[Tables], DataFrame]):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[key] = sql
        return f

    return add
