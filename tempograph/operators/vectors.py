"""Vectors: prototypes, exact top-k, fused scores, deterministic embeddings, binary codec, incremental indexing."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T
from pyspark.sql.functions import arrow_udf

from ..functions import similarity as S


def prototypes(vectors: DataFrame) -> DataFrame:
    """(label, proto): the mean of each label's vectors."""
    x = vectors.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return x.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("proto"))


def classify(vectors: DataFrame, protos: DataFrame, threshold: float = 0.42, top: int = 4, broadcast_rows: int = 10_000) -> DataFrame:
    """(vec_id, label, similarity, rank): prototypes with cosine >= threshold, the best ``top``, ties by label. Prototypes are broadcast only if they are few."""
    few = protos.limit(broadcast_rows + 1).count() <= broadcast_rows
    p = F.broadcast(protos) if few else protos
    p = p.withColumnRenamed("label", "l")
    x = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).crossJoin(p)
    x = x.select("vec_id", F.col("l").alias("label"), S.cosine(F.col("v"), F.col("proto")).alias("s")).where(F.col("s") >= threshold)
    w = W.partitionBy("vec_id").orderBy(F.desc("s"), "label")
    return x.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("vec_id", "label", F.round("s", 6).alias("similarity"), "rank")


def dense_topk(vectors: DataFrame, query: list[float], k: int, threshold: float = -1.0) -> DataFrame:
    """Exact cosine top-k for one query vector: one scan, TakeOrderedAndProject."""
    q = F.array(*[F.lit(float(x)) for x in query])
    x = vectors.select("vec_id", F.round(S.cosine(F.col("embedding").cast("array<double>"), q), 6).alias("similarity")).where(F.col("similarity") >= threshold)
    return x.orderBy(F.desc("similarity"), "vec_id").limit(k)


def neural_fused(topic: Column, cosine: Column, labels: Column) -> Column:
    """0.58 topic + 0.34 max(0, cosine) + 0.08 label overlap."""
    return 0.58 * topic + 0.34 * F.greatest(F.lit(0.0), cosine) + 0.08 * labels


def deterministic(dims: int):
    """An Arrow function: a unit vector from the SHA-256 of each 64 characters of the text, scattered over dims."""

    def one(t: str | None):
        if t is None:
            return None
        v = np.zeros(dims)
        for i in range(0, max(len(t), 1), 64):
            d = hashlib.sha256(t[i : i + 64].encode()).digest()
            for j in range(0, 32, 4):
                v[int.from_bytes(d[j : j + 2], "big") % dims] += int.from_bytes(d[j + 2 : j + 4], "big") / 32767.5 - 1
        n = np.sqrt((v * v).sum())
        return (v / n if n else v).tolist()

    return arrow_udf(lambda t: pa.array([one(x) for x in t.to_pylist()], pa.list_(pa.float64())), T.ArrayType(T.DoubleType()))


@arrow_udf(T.BinaryType())
def encode_f32(v: pa.Array) -> pa.Array:
    """Little-endian float32."""
    return pa.array([None if x is None else np.asarray(x, "<f4").tobytes() for x in v.to_pylist()], pa.binary())


@arrow_udf(T.ArrayType(T.FloatType()))
def decode_f32(b: pa.Array) -> pa.Array:
    return pa.array([None if x is None else np.frombuffer(x, "<f4").tolist() for x in b.to_pylist()], pa.list_(pa.float32()))


def to_embed(messages: DataFrame, index: DataFrame, fingerprint: str) -> DataFrame:
    """Messages (id, digest) without a vector of this digest and model fingerprint."""
    have = index.where(F.col("fingerprint") == fingerprint).select(F.col("id").alias("_i"), F.col("digest").alias("_d"))
    return messages.join(have, (F.col("id") == F.col("_i")) & F.col("digest").eqNullSafe(F.col("_d")), "left_anti")
