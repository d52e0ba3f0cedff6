"""The queries of the training-data operators, with their production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, chat, near_dedup, packing, perplexity, secret_scan, substring_dedup as repeats, token_count, topk, toxicity
from .common import Work, read


def op2_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_count(read(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(read(spark, sf_dir, "documents"))


def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.nearest(read(spark, sf_dir, "embeddings"))


def op6_quality_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.perplexity(read(spark, sf_dir, "documents"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = Work(spark, "chat").cut(chat.transcripts(read(spark, sf_dir, "conversations")))
    return chat.format_chats(raw, chat.fit(raw))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return secret_scan.secret_scan(docs, secret_scan.model(docs))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.substring_dedup(read(spark, sf_dir, "documents"))


def op10_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text's ids, and whether decoding them gives the text back."""
    x = read(spark, sf_dir, "documents").select("doc_id", bpe.checked_encoder()(F.col("text")).alias("e"))
    return x.select("doc_id", "e.ids", F.size("e.ids").alias("n_tokens"), "e.round_trip")


QUERIES = {"op5_topk_search": op5_topk_search, "op6_quality_perplexity": op6_quality_perplexity, "op9_chat_formatting": op9_chat_formatting, "op10_bpe_encoding": op10_bpe_encoding, "op2_token_count": op2_token_count, "op3_packing": op3_packing, "op1_substring_dedup": op1_substring_dedup, "op4_minhash_near_dedup": op4_minhash_near_dedup, "op7_secret_scan": op7_secret_scan, "op8_toxicity": op8_toxicity}
SQL: dict[str, str] = {"op5_topk_search": topk.SQL, "op1_substring_dedup": repeats.SQL}
