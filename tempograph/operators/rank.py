"""Fusion of ranked lists, and re-scoring of similar symbols."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import similarity as S


def ranked(df: DataFrame, *order, limit: int) -> DataFrame:
    """The first ``limit`` rows by ``order`` with rank 1, 2, ... The window sees those rows only."""
    return df.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(W.orderBy(*order)))


def reciprocal_rank_fusion(lists: dict[str, DataFrame], id_col: str, k: int = 60) -> DataFrame:
    """id, fused = sum of 1 / (k + rank), sources: the union of ranked lists (id, rank)."""
    parts = [d.select(id_col, "rank", F.lit(n).alias("source")) for n, d in lists.items()]
    x = reduce(DataFrame.unionByName, parts).groupBy(id_col, "source").agg(F.min("rank").alias("rank"))
    return x.groupBy(id_col).agg(F.round(F.sum(1 / (k + F.col("rank"))), 6).alias("fused"), F.array_join(F.array_sort(F.collect_list("source")), ",").alias("sources"))


def fused_search(lexical: DataFrame, topical: DataFrame, id_col: str, k: int = 60, weight: float = 0.85, gain: float = 0.01) -> DataFrame:
    """Lexical 1 / (k + rank) plus topical weight / (k + rank) + gain * score; a missing leg adds nothing. lexical: (id, rank, score), topical: (id, rank, score)."""
    a = lexical.select(id_col, F.col("rank").alias("lexical_rank"), F.col("score").alias("bm25"))
    b = topical.select(id_col, F.col("rank").alias("topic_rank"), F.col("score").alias("topic_score"))
    x = a.join(b, id_col, "full_outer")
    lex = F.coalesce(1 / (k + F.col("lexical_rank")), F.lit(0.0))
    top = F.coalesce(weight / (k + F.col("topic_rank")) + gain * F.col("topic_score"), F.lit(0.0))
    return x.withColumn("fused", F.round(lex + top, 6))


def similar_symbols(candidates: DataFrame, target: DataFrame, limit: int = 20) -> DataFrame:
    """candidates (id, rank, tokens, kind, namespace, features, node_count, depth, arity) re-scored against the one row of target: 0.30 / rank + 0.25 name overlap + 0.15 same kind + 0.05 same namespace + 0.25 structure."""
    t = target.select(*[F.col(c).alias(f"t_{c}") for c in ("id", "tokens", "kind", "namespace", "features", "node_count", "depth", "arity")])
    x = candidates.crossJoin(F.broadcast(t.limit(1))).where("id <> t_id")
    num = lambda c: S.numeric_similarity(F.col(c), F.col(f"t_{c}"))
    structure = S.structural_overlap(S.overlap(F.col("features"), F.col("t_features")), num("node_count"), num("depth"), num("arity"))
    score = 0.30 / F.col("rank") + 0.25 * S.overlap(F.col("tokens"), F.col("t_tokens")) + 0.15 * (F.col("kind") == F.col("t_kind")).cast("double") + 0.05 * (F.col("namespace") == F.col("t_namespace")).cast("double") + 0.25 * structure
    return x.select("id", F.round(structure, 6).alias("structural"), F.round(score, 6).alias("score")).orderBy(F.desc("score"), "id").limit(limit)
