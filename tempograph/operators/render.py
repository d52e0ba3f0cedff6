"""Markdown of messages and context bundles, and bounded public projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as X

ROLES = {"user": "User", "assistant": "Assistant", "system": "System", "tool": "Tool"}


def role(c: Column) -> Column:
    return F.coalesce(*[F.when(c == k, v) for k, v in ROLES.items()], F.initcap(c), F.lit("Unknown"))


def blocks(c: Column) -> Column:
    """Markdown of an array of blocks (type, text, language, url): code in a fence that its text can't close, links and images by their form, other text as it is."""

    def one(b: Column) -> Column:
        t = F.coalesce(b["text"], F.lit(""))
        f = X.fence(t)
        code = F.concat(f, F.coalesce(b["language"], F.lit("")), F.lit("\n"), t, F.lit("\n"), f)
        link = F.concat(F.lit("["), F.coalesce(F.nullif(t, F.lit("")), b["url"]), F.lit("]("), F.coalesce(b["url"], F.lit("")), F.lit(")"))
        return F.when(b["type"] == "code", code).when(b["type"] == "image", F.concat(F.lit("!"), link)).when(b["type"] == "link", link).otherwise(t)

    return F.array_join(F.filter(F.transform(c, lambda b: one(b)), lambda s: s != ""), "\n\n")


def bundle(packed: DataFrame, messages: DataFrame, group: str = "query") -> DataFrame:
    """One Markdown text for each packed query: messages in order under their citation and role."""
    m = messages.select("message", F.col("role").alias("_role"))
    x = packed.join(m, "message").withColumn("_n", F.regexp_extract("citation", r"(\d+)", 1).cast("int"))
    part = F.concat(F.lit("### ["), F.col("citation"), F.lit("] "), role(F.col("_role")), F.lit("\n\n"), F.col("content"), F.when(F.col("truncated"), F.lit("\n\n_(truncated)_")).otherwise(F.lit("")))
    x = x.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("_n", part.alias("t")))).alias("a"))
    return x.select(group, F.array_join(F.transform("a", lambda s: s["t"]), "\n\n").alias("markdown"))


def preview(hits: DataFrame, limit: int = 1200) -> DataFrame:
    """Search hits with a text of at most ``limit`` characters and a provenance struct of their other columns."""
    rest = [c for c in hits.columns if c not in ("content", "score", "rank")]
    keep = [c for c in ("score", "rank") if c in hits.columns]
    return hits.select(*keep, X.compact_label(F.col("content"), limit).alias("preview"), F.struct(*rest).alias("provenance"))


def public_conversation(messages: DataFrame, edges: DataFrame, max_messages: int = 200, message_bytes: int = 32 << 10, total_bytes: int = 512 << 10, max_edges: int = 1000) -> tuple[DataFrame, DataFrame]:
    """A bounded view of conversations: messages (conversation, position, message, role, content) in order while they are within the number and the bytes, each text cut at a character's end, with ``truncated`` where a conversation has more; and the edges among them, at most ``max_edges`` a conversation."""
    by = W.partitionBy("conversation")
    size = F.least(F.octet_length(F.coalesce("content", F.lit(""))), F.lit(message_bytes))
    x = messages.withColumn("n_bytes", size).withColumn("_run", F.sum("n_bytes").over(by.orderBy("position", "message"))).withColumn("_r", F.row_number().over(by.orderBy("position", "message")))
    within = (F.col("_run") <= total_bytes) & (F.col("_r") <= max_messages)
    x = x.withColumn("truncated", F.count(F.when(within, 1)).over(by) < F.count("*").over(by)).where(within)
    text = F.when(F.octet_length("content") > message_bytes, X.cut_bytes(message_bytes)("content")).otherwise(F.col("content"))
    m = x.select("conversation", "position", "message", "role", text.alias("content"), "n_bytes", "truncated")
    e = edges.join(m.select("conversation", F.col("message").alias("from_message")), ["conversation", "from_message"], "left_semi").join(m.select("conversation", F.col("message").alias("to_message")), ["conversation", "to_message"], "left_semi")
    e = e.withColumn("_r", F.row_number().over(by.orderBy("from_message", "to_message"))).where(F.col("_r") <= max_edges).drop("_r")
    return m, e


def closed(payload: dict, keys: set[str]) -> dict:
    """A response that has just these keys; others are refused, not dropped."""
    if set(payload) != set(keys):
        raise ValueError(f"keys {sorted(set(payload) ^ set(keys))} are missing or unknown")
    return payload


def fits(c: Column, limit: int = 900 * 1024) -> Column:
    """Whether a response stays under the size bound."""
    return F.octet_length(c) <= limit
