"""Toxic passages by maximum-scoring segments of token log-odds.

Fit: a bounded hash sample of labelled rows (``max_train`` per class and language is the documented bound) gives
for each language the token counts of both classes. A token counts once for each distinct (previous, token, next)
context, so a passage copied many times is one observation. Scores are log-odds under a Dirichlet prior with the
pooled distribution as its mean. Tokens whose signed-root likelihood ratio is below ``z_min`` share one score, that
of all of them together (likewise those whose log-odds are below ``effect_min``); it is negative, and the scores stay exact log-likelihood ratios (so lambda = 1).

Score: the linear scan of Ruzzo and Tompa finds every maximal-scoring segment. A segment of score S among n tokens
has at most the expected count n * exp(-S) under the clean model (K <= 1, lambda = 1); the r best segments of a
document are joined by the Karlin-Altschul sum statistic with a 2^-r correction, and the smallest value is the
document's p-value.

Defined results: null and empty texts have p = 1 and no passage. A null language, or one without a lexicon, is
scored by the pooled lexicon. Without any toxic label nothing is toxic. Repeated rows are scored each. Null doc_ids
are scored but can't be labelled. Extra columns, whatever their names, are not touched.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T, Window as W
from pyspark.sql.functions import arrow_udf

from .common import U64, Work, mix, release, slices, utf8, words

POOLED = "*"


def _contexts(text: pa.Array) -> pa.Array:
    """For each text its distinct (word, context) hashes, some texts at a time."""
    release()
    data, off = utf8(text)
    w, c, count = [np.zeros(0, U64)], [np.zeros(0, U64)], [np.zeros(1, np.int64)]
    for lo, hi in slices(off):
        _, _, h, first = words(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        doc = np.repeat(np.arange(hi - lo), np.diff(first))
        with np.errstate(over="ignore"):
            prev, nxt = np.zeros_like(h), np.zeros_like(h)
            prev[1:], nxt[:-1] = h[:-1], h[1:]
            prev[first[:-1][first[:-1] < len(h)]] = 0
            ends = first[1:][first[1:] > first[:-1]] - 1
            nxt[ends] = 0
            ctx = mix(prev * U64(3) ^ mix(h ^ mix(nxt + U64(7))))
            one = np.sort(np.unique(mix(ctx + mix(doc.astype(U64))), return_index=True)[1])
        w.append(h[one])
        c.append(ctx[one])
        count.append(np.bincount(doc[one], minlength=hi - lo))
    items = pa.StructArray.from_arrays([pa.array(np.concatenate(w).view(np.int64)), pa.array(np.concatenate(c).view(np.int64))], ["w", "c"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate(count).cumsum().astype(np.int32)), items)


def fit(docs: DataFrame, labels: DataFrame, max_train: int = 10_000, prior: float = 500.0, z_min: float = 4.0, effect_min: float = 1.0) -> dict:
    """{language: (sorted token hashes, their scores, score of the other tokens)}. The sample is at most 2 * max_train rows, so labels of that many rows are broadcast; docs is not shuffled."""
    lab = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("y"))
    pick = W.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id")
    lab = lab.withColumn("rn", F.row_number().over(pick)).where(F.col("rn") <= max_train).select(F.col("doc_id").alias("id"), "y")
    contexts = arrow_udf(_contexts, T.ArrayType(T.StructType([T.StructField("w", T.LongType()), T.StructField("c", T.LongType())])))
    text = docs.select(F.col("doc_id").alias("id"), F.coalesce("lang", F.lit("")).alias("g"), F.lower("text").alias("t"))
    tok = text.join(F.broadcast(lab), "id").select("g", "y", F.explode(contexts("t")).alias("s")).select("g", "y", "s.w", "s.c").distinct()
    by = Work(docs.sparkSession, "toxicity").cut(tok.groupBy("g", "w").agg(F.sum("y").alias("c1"), F.sum(1 - F.col("y")).alias("c0")))
    n = by.groupBy("g").agg(F.sum("c1").alias("n1"), F.sum("c0").alias("n0"))
    totals = {r.g: (r.n1, r.n0) for r in n.collect()}  # a row for each language
    t1, t0 = (sum(x[i] for x in totals.values()) for i in (0, 1))
    if not t1 or not t0:
        return {}
    pooled = by.groupBy("w").agg(F.sum("c1").alias("c1"), F.sum("c0").alias("c0")).select(F.lit(POOLED).alias("g"), "w", "c1", "c0")
    sums = by.sparkSession.createDataFrame([(g, *map(float, x)) for g, x in (totals | {POOLED: (t1, t0)}).items()], "g string, n1 double, n0 double")
    both = by.unionByName(pooled).where("c1 > 1").join(F.broadcast(sums), "g").where("n1 > 0 and n0 > 0")
    share = F.col("n1") / (F.col("n1") + F.col("n0"))
    c = F.col("c1") + F.col("c0")
    log = lambda k, e: F.when(k > 0, k * F.log(k / (c * e))).otherwise(0.0)
    z = F.sqrt(F.greatest(F.lit(0.0), 2 * (log(F.col("c1"), share) + log(F.col("c0"), 1 - share))))
    rows = both.where((F.col("c1") > c * share) & (z >= z_min)).select("g", "w", "c1", "c0", "n1", "n0").collect()  # significant tokens of the bounded sample
    model: dict = {}
    for g in {r.g for r in rows}:
        own = sorted((r for r in rows if r.g == g), key=lambda r: r.w & (1 << 64) - 1)
        n1, n0 = own[0].n1, own[0].n0
        c1, c0 = (np.array([float(getattr(r, k)) for r in own]) for k in ("c1", "c0"))
        a = prior * (c1 + c0) / (n1 + n0)
        p1, p0 = (c1 + a) / (n1 + prior), (c0 + a) / (n0 + prior)
        keep = np.log(p1 / p0) >= effect_min
        p1, p0 = p1[keep], p0[keep]
        if len(p1) and p1.sum() < 1 and p0.sum() < p1.sum():
            model[g] = (np.array([r.w for r in own], np.int64).view(U64)[keep], np.log(p1 / p0), math.log((1 - p1.sum()) / (1 - p0.sum())))
    return model


def segments(pos: list[int], score: list[float], n: int, other: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (Ruzzo and Tompa) of n tokens of which those at ``pos`` have ``score``, the rest ``other`` < 0: (first token, past the last, score)."""
    out: list[list[float]] = []  # start, end, sum before, sum after
    total, at = 0.0, 0
    for p, s in zip(pos, score, strict=True):
        total += (p - at) * other
        at = p + 1
        seg = [p, p + 1, total, total + s]
        total += s
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= seg[2]:
                j -= 1
            if j < 0 or out[j][3] >= seg[3]:
                out.append(seg)
                break
            seg = [out[j][0], seg[1], out[j][2], seg[3]]
            del out[j:]
    return [(int(a), int(b), hi - lo) for a, b, lo, hi in out]


def calibrate(scores: list[float], n: int) -> float:
    """p-value of a document with these segment scores among n tokens."""
    best, total, fact = 1.0, 0.0, 0.0
    for r, s in enumerate(sorted(scores, reverse=True), 1):
        total += s - math.log(n)
        if total <= 0 and r > 1:
            break
        if r == 1:
            p = -math.expm1(-math.exp(min(50.0, -total)))
        else:
            fact += math.log(r) + math.log(r - 1) if r > 2 else math.log(2)
            p = math.exp(min(0.0, -total + (r - 1) * math.log(total) - fact))
        best = min(best, p * 2.0**r)
    return max(0.0, min(1.0, best))


OUT = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("p_value", T.DoubleType()), T.StructField("passages", T.ArrayType(T.StructType([T.StructField("first_word", T.IntegerType()), T.StructField("end_word", T.IntegerType()), T.StructField("score", T.DoubleType())])))])
_PASSAGE = pa.struct([("first_word", pa.int32()), ("end_word", pa.int32()), ("score", pa.float64())])


def scorer(model: dict, p_max: float = 0.05):
    """An Arrow UDF over (lower-case text, language)."""
    bits = 1 << 20
    tables = {g: (*m, np.bincount((m[0] & U64(bits - 1)).astype(np.int64), minlength=bits) > 0) for g, m in model.items()}

    def score(text: pa.Array, lang: pa.Array) -> pa.Array:
        release()
        data, off = utf8(text)
        langs = lang.to_pylist()
        n = len(off) - 1
        best, pval, passages = np.zeros(n), np.ones(n), [[] for _ in range(n)]
        for lo, hi in slices(off):
            _, _, h, first = words(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            low = (h & U64(bits - 1)).astype(np.int64)
            for i0 in {langs[i] if langs[i] in tables else POOLED for i in range(lo, hi)} & tables.keys():
                w, s, other, there = tables[i0]
                hit = np.flatnonzero(there[low])
                k = np.searchsorted(w, h[hit])
                ok = (k < len(w)) & (w[np.minimum(k, len(w) - 1)] == h[hit])
                hit, k = hit[ok], k[ok]
                doc = np.searchsorted(first, hit, "right") - 1
                cuts = np.flatnonzero(np.diff(doc, prepend=-1))
                for a, b in zip(cuts, np.append(cuts[1:], len(doc))[: len(cuts)], strict=True):
                    d = int(doc[a])
                    if (langs[lo + d] if langs[lo + d] in tables else POOLED) != i0:
                        continue
                    m = int(first[d + 1] - first[d])
                    seg = segments((hit[a:b] - first[d]).tolist(), s[k[a:b]].tolist(), m, other)
                    best[lo + d], pval[lo + d] = max(x[2] for x in seg), calibrate([x[2] for x in seg], m)
                    passages[lo + d] = [{"first_word": x, "end_word": y, "score": z} for x, y, z in seg if m * math.exp(-z) <= p_max]
        return pa.StructArray.from_arrays([pa.array(best), pa.array(pval), pa.array(passages, pa.list_(_PASSAGE))], ["score", "p_value", "passages"])

    return arrow_udf(score, OUT)


def score(docs: DataFrame, model: dict, p_max: float = 0.05) -> DataFrame:
    """doc_id, score of the best passage, p_value, passages, toxic: a row for each row of docs."""
    x = docs.select("doc_id", scorer(model, p_max)(F.lower("text"), F.col("lang")).alias("s"))
    return x.select("doc_id", F.round("s.score", 6).alias("score"), "s.p_value", "s.passages", (F.col("s.p_value") <= p_max).alias("toxic"))


def keep_clean(docs: DataFrame, model: dict, p_max: float = 0.05) -> DataFrame:
    """The rows of docs that aren't toxic, with all their columns."""
    return docs.where(scorer(model, p_max)(F.lower(docs["text"]), docs["lang"])["p_value"] > p_max)
