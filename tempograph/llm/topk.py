"""Exact k nearest neighbours of every vector by a three-phase uniform threshold over dimension lists.

Vectors are normalised; the squared distance of two is the sum of ``lists`` partial distances, one for each run of
dimensions, all of them >= 0. Rows are in blocks, and a tile is a block of queries against a block of vectors that holds all
the lists of its rows, so list entries need no network to be joined.

1. Each tile gathers for each query the k smallest entries of each of its lists, completes their sums, and sends the k
   smallest sums. The k-th smallest over all tiles is a cutoff c that is surely enough for k neighbours.
2. A vector with a sum of at most c has a list entry of at most c / lists: tiles collect just those entries.
3. Sums of the collected that stay within the cutoff are resolved exactly, in double precision, and ranked.

Queries are the rows whose id is divisible by ``every`` (1: all), against all rows. Blocks of queries with their cutoffs are
broadcast to the vectors, which then stay where they are, if all of them together are within BROADCAST bytes; else both sides
are joined by tile. Arrow batches hold as many tiles as spark.sql.execution.arrow.maxBytesPerBatch allows.

Defined results: null, empty, zero and non-finite vectors, those of another length than the most common, and null ids have
no neighbours and are none. Of rows with the same id the smallest vector counts. A vector is not its own neighbour; ties go
to the smaller id, which is of an integer type. With k others or fewer, all are neighbours. An empty table gives no row. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, Window as W

from .common import Work, integral, release

MARGIN = 1e-5
STRIP = 512
#: Bytes of queries that are broadcast at most; partitions at most; tiles whose sums meet in one task.
BROADCAST = 32 << 20
MOST = 4096
LEVEL = 512


def _vectors(ids: bytes, vec: bytes) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, np.int64)
    return ids, np.frombuffer(vec, np.float64).reshape(len(ids), -1)


def _lists(q: np.ndarray, x: np.ndarray, lists: int) -> list[np.ndarray]:
    """Partial squared distances, a matrix for each list."""
    out = []
    for a, b in zip(np.array_split(q.astype(np.float32), lists, axis=1), np.array_split(x.astype(np.float32), lists, axis=1), strict=True):
        d = a @ b.T
        d *= -2
        d += (a * a).sum(axis=1)[:, None]
        d += (b * b).sum(axis=1)[None, :]
        out.append(np.maximum(d, 0, out=d))
    return out


def _self(qi: np.ndarray, xi: np.ndarray, d: np.ndarray) -> None:
    """A vector is not its own neighbour; xi is in order."""
    at = np.minimum(np.searchsorted(xi, qi), len(xi) - 1)
    i = np.flatnonzero(xi[at] == qi)
    d[i, at[i]] = np.inf


def strips(n: int) -> list[slice]:
    """A tile's queries some at a time, as they don't depend on each other: bounds the matrices in memory."""
    return [slice(i, i + STRIP) for i in range(0, n, STRIP)]


def local_sums(qi: np.ndarray, q: np.ndarray, xi: np.ndarray, x: np.ndarray, k: int, lists: int) -> np.ndarray:
    """Phase 1 in a tile: the k smallest sums among the objects that lead some list; infinite where there are fewer."""
    parts = _lists(q, x, lists)
    total = sum(parts[1:], parts[0].copy())
    _self(qi, xi, total)
    lead = min(k + 1, len(xi))
    top = [np.argpartition(p, lead - 1, axis=1)[:, :lead] if lead < len(xi) else np.broadcast_to(np.arange(len(xi)), p.shape) for p in parts]
    at = np.sort(np.concatenate(top, axis=1), axis=1)
    s = np.take_along_axis(total, at, axis=1)
    s[:, 1:][at[:, 1:] == at[:, :-1]] = np.inf
    s = np.sort(s, axis=1)[:, :k]
    return np.pad(s, ((0, 0), (0, k - s.shape[1])), constant_values=np.inf).astype(np.float64)


def collect(qi: np.ndarray, q: np.ndarray, xi: np.ndarray, x: np.ndarray, cut: np.ndarray, lists: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phases 2 and 3 in a tile: queries, neighbours and their exact cosine similarities, for all within the cutoffs."""
    parts = _lists(q, x, lists)
    share = (cut / lists + MARGIN).astype(np.float32)[:, None]
    seen = parts[0] <= share
    for p in parts[1:]:
        seen |= p <= share
    i, j = np.nonzero(seen)
    s = parts[0][i, j]
    for p in parts[1:]:
        s = s + p[i, j]
    ok = (s <= cut[i] + MARGIN) & (qi[i] != xi[j])
    i, j = i[ok], j[ok]
    return qi[i], xi[j], np.einsum("ij,ij->i", q[i], x[j])


def nearest(vectors: DataFrame, k: int = 10, lists: int = 4, block: int = 2048, every: int = 50) -> DataFrame:
    """query_id, rank, neighbour_id, similarity (cosine, 6 decimals) for the rows whose id is divisible by ``every``, against all rows."""
    integral(vectors, "vec_id")
    spark = vectors.sparkSession
    work = Work(spark, "topk")
    v = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v")).where("id is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
    v = v.withColumn("s", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).where("s > 0")
    query = F.col("id") % every == 0
    sizes = v.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.count_if(query).alias("m")).orderBy(F.desc("n"), F.desc("d")).first()
    if sizes is None or not sizes.m:
        return spark.createDataFrame([], "query_id long, rank int, neighbour_id long, similarity double")
    v = v.where(F.size("v") == sizes.d).groupBy("id").agg(F.min("v").alias("v"))
    blocks, asked = -(-sizes.n // block), -(-sizes.m // block)

    def gather(p: pd.DataFrame) -> pd.DataFrame:
        release()
        p = p.sort_values("id")
        x = np.stack(p.v.to_list())
        x = x / np.sqrt((x * x).sum(axis=1))[:, None]
        return pd.DataFrame({"b": [int(p.b.iloc[0])], "ids": [p.id.to_numpy(np.int64).tobytes()], "vec": [x.tobytes()]})

    def blocked(rows: DataFrame, n: int) -> DataFrame:
        return work.cut(rows.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(n))).groupBy("b").applyInPandas(gather, "b long, ids binary, vec binary"))

    o = blocked(v, blocks).select(F.col("b").alias("o"), F.col("ids").alias("xi"), F.col("vec").alias("xv"))
    q = blocked(v.where(query), asked).select("b", F.col("ids").alias("qi"), F.col("vec").alias("qv"))

    def phase1(batches):
        release()
        for p in batches:
            for r in p.itertuples():
                (qi, q), (xi, x) = _vectors(r.qi, r.qv), _vectors(r.xi, r.xv)
                sums = np.concatenate([local_sums(qi[s], q[s], xi, x, k, lists) for s in strips(len(qi))])
                yield pd.DataFrame({"b": [r.b], "sums": [sums.tobytes()]})

    def cutoff(p: pd.DataFrame) -> pd.DataFrame:
        c = np.frombuffer(_least(p, k).sums[0], np.float64).reshape(-1, k).max(axis=1)
        return pd.DataFrame({"b": [int(p.b.iloc[0])], "cut": [np.where(np.isfinite(c), c, 1e9).tobytes()]})

    def phase23(batches):
        for p in batches:
            for r in p.itertuples():
                (qi, q), (xi, x), cut = _vectors(r.qi, r.qv), _vectors(r.xi, r.xv), np.frombuffer(r.cut, np.float64)
                for at in strips(len(qi)):
                    a, b, s = collect(qi[at], q[at], xi, x, cut[at], lists)
                    yield pd.DataFrame({"query_id": a, "neighbour_id": b, "s": s})

    few = sizes.m * (sizes.d + 1) * 8 <= BROADCAST

    def tiled(q: DataFrame) -> DataFrame:
        """Each block of queries with each block of vectors: few queries go to the vectors, many meet them in a partition for each tile."""
        if few:
            return o.repartition(min(blocks, MOST), "o").crossJoin(F.broadcast(q))
        tiles = spark.range(blocks * asked).select((F.col("id") % asked).alias("b"), F.floor(F.col("id") / asked).alias("o"))
        return tiles.repartition(min(blocks * asked, MOST), "b", "o").join(q, "b").join(o, "o")

    sums = work.cut(tiled(q).mapInPandas(phase1, "b long, sums binary"))
    if sizes.n // block > LEVEL:  # a block's sums meet in two steps, so that no task reads a row of every tile
        sums = sums.withColumn("r", F.pmod(F.xxhash64("sums"), F.lit(-(-blocks // LEVEL))))
        sums = sums.groupBy("b", "r").applyInPandas(lambda p: _least(p, k), "b long, sums binary")
    q = work.cut(q.join(sums.groupBy("b").applyInPandas(cutoff, "b long, cut binary"), "b"))
    found = work.cut(tiled(q).mapInPandas(phase23, "query_id long, neighbour_id long, s double"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("s"), "neighbour_id"))
    return found.select("query_id", "neighbour_id", "s", rank.alias("rank")).where(F.col("rank") <= k).select("query_id", "rank", "neighbour_id", F.round("s", 6).alias("similarity"))


def _least(p: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k smallest sums of each query over some tiles."""
    best = None
    for r in p.sums:
        s = np.frombuffer(r, np.float64).reshape(-1, k)
        best = s if best is None else np.sort(np.concatenate([best, s], axis=1), axis=1)[:, :k]
    return pd.DataFrame({"b": [int(p.b.iloc[0])], "sums": [np.ascontiguousarray(best).tobytes()]})


SQL = """
WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (SELECT q.id AS query_id, x.id AS neighbour_id, list_cosine_similarity(q.v, x.v) AS s FROM v q JOIN v x ON q.id <> x.id WHERE q.id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, neighbour_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, neighbour_id, round(s, 6) AS similarity FROM r WHERE rank <= 10
"""
