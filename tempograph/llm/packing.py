"""Cost-balanced packing of documents into sequences of a token capacity.

The cost of a piece of n tokens is linear * n + quadratic * n * n (attention within the piece). Texts longer than the
capacity are cut into pieces of it. Pieces are spread by hash over shards of about ``shard_tokens`` tokens, so that the
number of shards follows the corpus and each shard is the same bounded work at any size. Within a shard as many sequences
are opened as its tokens need at least; pieces in descending order (ties by doc_id, then start) each go to the sequence of
lowest cost that has room (ties to the first opened), and a further sequence opens where none has room.

Defined results: null and empty texts have no piece. Repeated rows are packed each. Null doc_ids are packed, last among
ties; doc_id must be of an integer type. An empty table gives no row. Extra columns are not in the result. Only doc_id and lengths are shuffled.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import Work, integral
from .token_count import VOCABULARY, counter

SCHEMA = "sequence_id long, position int, doc_id long, start_token long, n_tokens long, cost double"


def assign(n: np.ndarray, cost: np.ndarray, capacity: int) -> np.ndarray:
    """The sequence of each piece, pieces given in descending order."""
    k = max(1, -(-int(n.sum()) // capacity))
    room, total = np.full(k, capacity, np.int64), np.zeros(k)
    out = np.empty(len(n), np.int64)
    for i, (x, c) in enumerate(zip(n.tolist(), cost.tolist(), strict=True)):
        j = int(np.where(room >= x, total, np.inf).argmin())
        if room[j] < x:
            j = len(room)
            room, total = np.append(room, capacity), np.append(total, 0.0)
        room[j] -= x
        total[j] += c
        out[i] = j
    return out


def pack(docs: DataFrame, capacity: int = 8192, linear: float = 1.0, quadratic: float = 1 / 4096, shard_tokens: int = 1 << 22, path: str = VOCABULARY) -> DataFrame:
    """sequence_id, position, doc_id, start_token, n_tokens, cost: a row for each piece."""
    integral(docs, "doc_id")
    counts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), counter(path)(F.col("text")).alias("n"))
    # written before it is filtered: a filter on the count would be pushed below it and count twice
    counts = Work(docs.sparkSession, "packing").cut(counts).where("n > 0")
    total = counts.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-total // shard_tokens))
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(capacity).cast("long")))
    pieces = counts.select("doc_id", "n", start.alias("start_token"))
    pieces = pieces.select("doc_id", "start_token", F.least(F.col("n") - F.col("start_token"), F.lit(capacity)).alias("n_tokens"))
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "start_token"), F.lit(shards)))

    def one(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["n_tokens", "doc_id", "start_token"], ascending=[False, True, True], na_position="last", kind="stable", ignore_index=True)
        n = p.n_tokens.to_numpy(np.int64)
        p["cost"] = linear * n + quadratic * n.astype(float) ** 2
        at = assign(n, p.cost.to_numpy(), capacity)
        p["sequence_id"] = p.shard.iloc[0] * (1 << 32) + at
        p["position"] = p.groupby("sequence_id").cumcount().astype("int32")
        p["doc_id"] = p.doc_id.astype("Int64")
        return p[["sequence_id", "position", "doc_id", "start_token", "n_tokens", "cost"]]

    return pieces.groupBy("shard").applyInPandas(one, SCHEMA)
