"""Documents out of their language's perplexity band, by a modified Kneser-Ney model over bytes.

Fit: every text of the corpus is counted. Map tasks count the n-grams of ``ORDER`` bytes of all their texts, Spark adds the
counts; the lower orders' continuation counts come from the table of the next higher order. Discounts are those of Chen
and Goodman for each language and order; probabilities are interpolated down to the uniform distribution, by joins. The
model is written by language to the shared work folder. A worker reads the languages that it meets and holds each as
arrays of hashed n-grams in sorted order, with an index by leading bits; at most ``HELD`` languages at a time.

Score: mean negative log-probability of a text's bytes (log of the perplexity). The band of a language is its median plus and
minus ``width`` standard errors, s^2 = sigma^2 + slack * tau^2 / bytes: sigma from the median absolute deviation of the
longer texts, tau^2 the mean variance of a byte's log-probability, so short texts have wide bands.

Five bytes see about one word, so two scores of the text as a whole have an upper limit each, of the same form: the mean
negative log-probability of what stands between words (spaces, marks) in its language, which is high where the marks are
not those of the language's texts however regular they are; and the share of word pairs that stood in the text before.

``rejected`` is: outside the band or above a limit. perplexity, low and high are those of the bytes.

Defined results: null and empty texts have null perplexity and are kept. A null language is a language of its own, ''.
Repeated rows are counted and scored each; null doc_ids too. A language with one text keeps it. An empty table gives no
row. Extra columns are not in the result.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.functions import arrow_udf

from .common import _WORD, U64, Work, held, mix, release, slices, span_hash, utf8, words

ORDER = 5
HELD = 8
LONG = 500
#: Kind of a model's row for what stands between words, and the number of them that makes a text a longer one.
GAP = 20
LONG_GAPS = 50
#: Log-probability that one gap counts with at least, so that no few rare ones (a telephone number's) reject a text.
RARE = -6.0
#: Bytes of text in one step; bounds a worker's memory.
STEP = 1 << 20


def grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram (packed, ORDER bytes) that ends at each byte and at each text's end mark, and each text's first index. Before a text stand zero bytes."""
    n, pad = len(off) - 1, ORDER - 1
    size = np.diff(off)
    start = np.concatenate([[0], np.cumsum(size + 1 + pad)])
    buf = np.zeros(start[-1], np.int64)
    doc = np.repeat(np.arange(n), size)
    buf[np.arange(len(data)) + (start[:-1] - off[:-1])[doc] + pad] = data
    buf[start[1:] - 1] = 3
    key = buf.copy()
    for j in range(1, ORDER):
        key[j:] |= buf[:-j] << (8 * j)
    first = np.concatenate([[0], np.cumsum(size + 1)])
    doc = np.repeat(np.arange(n), size + 1)
    return key[np.arange(first[-1]) + (start[:-1] - first[:-1])[doc] + pad], first


def _count(batches):
    """(g, k, c): counts of all n-grams of a partition's texts."""
    release()
    names: dict[str, int] = {}
    parts: list[tuple[np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        k, c = (np.concatenate([x[i] for x in parts]) for i in (0, 1))
        order = np.argsort(k)
        k, c = k[order], c[order]
        first = np.flatnonzero(np.diff(k, prepend=-1))
        return k[first], np.add.reduceat(c, first)

    for b in batches:
        data, off = utf8(b.column(1))
        lang = np.array([names.setdefault(x, len(names)) for x in b.column(0).to_pylist()], np.int64)
        for lo, hi in slices(off, STEP):
            key, first = grams(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            key += np.repeat(lang[lo:hi] << 40, np.diff(first))
            parts.append(np.unique(key, return_counts=True))
            if sum(len(k) for k, _ in parts) > 1 << 21:
                parts[:] = [merged()]
    if parts:
        k, c = merged()
        by = list(names)
        for i in range(0, len(k), 1 << 18):
            part = k[i : i + (1 << 18)]
            g = pa.DictionaryArray.from_arrays(pa.array((part >> 40).astype(np.int32)), pa.array(by, pa.string())).cast(pa.string())
            yield pa.RecordBatch.from_arrays([g, pa.array(part & (1 << 40) - 1), pa.array(c[i : i + (1 << 18)].astype(np.int64))], ["g", "k", "c"])


def gaps(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of bytes outside words, and the first run's index for each text (n + 1 of them)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    out = ~_WORD[data]
    first = np.zeros(len(data), bool)
    first[off[:-1][off[:-1] < len(data)]] = True
    start = np.flatnonzero(out & (~np.concatenate([[False], out[:-1]]) | first))
    end = np.flatnonzero(out & (~np.concatenate([out[1:], [False]]) | np.concatenate([first[1:], [True]]))) + 1
    return span_hash(data, start, end).view(np.int64), np.searchsorted(start, off)


def _count_gaps(batches):
    """(g, k, c): counts of what stands between words, a step at a time."""
    release()
    for b in batches:
        data, off = utf8(b.column(1))
        langs = np.array(b.column(0).to_pylist(), object)
        for lo, hi in slices(off, STEP):
            k, first = gaps(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            of = np.repeat(langs[lo:hi], np.diff(first))
            for g in set(langs[lo:hi]):
                own, c = np.unique(k[of == g], return_counts=True)
                if len(own):
                    yield pa.RecordBatch.from_arrays([pa.array([g] * len(own), pa.string()), pa.array(own), pa.array(c.astype(np.int64))], ["g", "k", "c"])


def fit(docs: DataFrame, work: Work) -> str:
    """Writes the model; its folder. Rows (g, t, k, v): t = n for an n-gram's log-probability, 10 + n for the log of the back-off weight of a context of n bytes, GAP for the log-probability of what stands between words."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("lang", F.lit("")).alias("g"), "text").where(F.length("text") > 0)
    top = texts.mapInArrow(_count, "g string, k long, c long").groupBy("g", "k").agg(F.sum("c").alias("c"))
    tables = {ORDER: work.cut(top)}
    for n in range(ORDER - 1, 0, -1):
        mask = (1 << 8 * n) - 1
        tables[n] = work.cut(tables[n + 1].groupBy("g", F.col("k").bitwiseAND(F.lit(mask)).alias("k")).agg(F.count("*").alias("c")))
    below, parts = None, []
    for n in range(1, ORDER + 1):
        t = tables[n]
        cc = t.groupBy("g").agg(*[F.sum((F.col("c") == i).cast("double")).alias(f"n{i}") for i in (1, 2, 3, 4)])
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
        ok = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col("n3") > 0)
        disc = [F.when(ok, F.greatest(F.lit(0.05), F.least(F.lit(float(i) - 0.05), i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}")))).otherwise(i / 2).alias(f"d{i}") for i in (1, 2, 3)]
        d = F.broadcast(cc.select("g", *disc))  # a row for each language
        t = t.join(d, "g").withColumn("d", F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))).withColumn("h", F.shiftright("k", 8))
        ctx = t.groupBy("g", "h").agg(F.sum("c").alias("s"), F.sum("d").alias("m"))
        p = t.join(ctx, ["g", "h"])
        gamma, own = F.col("m") / F.col("s"), (F.col("c") - F.col("d")) / F.col("s")
        if below is None:
            p = p.select("g", "k", (own + gamma / 256).alias("p"))
        else:
            low = below.select(F.col("g").alias("lg"), F.col("k").alias("lk"), F.col("p").alias("lp"))
            p = p.join(low, (F.col("g") == F.col("lg")) & (F.col("k").bitwiseAND(F.lit((1 << 8 * (n - 1)) - 1)) == F.col("lk"))).select("g", "k", (own + gamma * F.col("lp")).alias("p"))
        p = work.cut(p)
        parts += [p.select("g", F.lit(n).alias("t"), "k", F.log("p").cast("float").alias("v")), ctx.select("g", F.lit(9 + n).alias("t"), F.col("h").alias("k"), F.log(gamma).cast("float").alias("v"))]
        below = p
    between = work.cut(texts.mapInArrow(_count_gaps, "g string, k long, c long").groupBy("g", "k").agg(F.sum("c").alias("c")))
    every = F.broadcast(between.groupBy("g").agg(F.sum("c").alias("s")))  # a row for each language
    parts.append(between.join(every, "g").select("g", F.lit(GAP).alias("t"), "k", F.log(F.col("c") / F.col("s")).cast("float").alias("v")))
    model = parts[0]
    for x in parts[1:]:
        model = model.unionByName(x)
    path = f"{work.root}/model"
    # the language as hexadecimal digits, as it names a folder
    model.select(F.concat(F.lit("x"), F.hex("g")).alias("g"), "t", "k", "v").repartition("g").write.partitionBy("g").parquet(path)
    return path


class Table:
    """Hashed keys in sorted order; start: the first entry of each value of the leading bits."""

    def __init__(self, key: np.ndarray, value: np.ndarray):
        h = mix(key.view(U64))
        order = np.argsort(h)
        self.h, self.v = h[order], value[order]
        self.shift = U64(64 - max(1, int(len(h)).bit_length()))
        lead = (self.h >> self.shift).astype(np.int64)
        self.start = np.searchsorted(lead, np.arange((1 << (64 - int(self.shift))) + 1)).astype(np.int32)

    def get(self, key: np.ndarray) -> np.ndarray:
        """Values; NaN where there is none."""
        h = mix(key.view(U64))
        lead = (h >> self.shift).astype(np.int64)
        at, end = self.start[lead], self.start[lead + 1]
        out = np.full(len(h), np.nan, np.float32)
        todo = np.flatnonzero(at < end)
        at, end, h = at[todo], end[todo], h[todo]
        while len(todo):
            hit = self.h[at] == h
            out[todo[hit]] = self.v[at[hit]]
            at = at + 1
            go = ~hit & (at < end)
            todo, at, end, h = todo[go], at[go], end[go], h[go]
        return out


def language(path: str, g: str) -> dict[int, Table]:
    models = held(("perplexity", path), OrderedDict)
    if g in models:
        models.move_to_end(g)
        return models[g]
    import pyarrow.dataset as ds
    from pyarrow import fs

    files, root = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    where = f"{root}/g=x{g.encode().hex().upper()}"
    out: dict[int, Table] = {}
    if files.get_file_info(where).type != fs.FileType.NotFound:
        x = ds.dataset(where, filesystem=files, format="parquet").to_table(columns=["t", "k", "v"])
        t, k, v = (x.column(c).to_numpy() for c in ("t", "k", "v"))
        out = {int(i): Table(k[t == i], v[t == i].astype(np.float32)) for i in np.unique(t)}
    models[g] = out
    while len(models) > HELD:
        models.popitem(last=False)
    return out


def log_probs(key: np.ndarray, model: dict[int, Table]) -> np.ndarray:
    """Log-probability of the last byte of each n-gram, backing off where it is not in the model."""
    out = np.zeros(len(key), np.float64)
    todo = np.arange(len(key))
    for n in range(ORDER, 0, -1):
        k = key[todo] & (1 << 8 * n) - 1
        p = model[n].get(k)
        miss = np.isnan(p)
        out[todo[~miss]] += p[~miss]
        todo, k = todo[miss], k[miss]
        if not len(todo):
            return out
        back = model[9 + n].get(k >> 8)
        out[todo] += np.nan_to_num(back, nan=0.0)
    out[todo] += -np.log(256)
    return out


def repeated_pairs(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text: its number of word pairs, and how many of them stood in it before."""
    n = len(off) - 1
    _, _, h, first = words(data, off)
    doc = np.repeat(np.arange(n), np.diff(first))
    same = np.flatnonzero(doc[1:] == doc[:-1])
    with np.errstate(over="ignore"):
        key = mix(mix(h[same] * U64(3) + doc[same].astype(U64)) ^ h[same + 1])
    pairs = np.bincount(doc[same], minlength=n)
    return pairs, pairs - np.bincount(doc[same[np.unique(key, return_index=True)[1]]], minlength=n)


FIELDS = ("n", "s1", "s2", "gn", "g1", "g2", "pn", "p1")


def scorer(path: str):
    """An Arrow UDF over (text, language): number of bytes, sum and sum of squares of their log-probabilities; the same of what stands between words; word pairs and repeated ones."""

    def score(text: pa.Array, lang: pa.Array) -> pa.Array:
        data, off = utf8(text)
        langs = [x or "" for x in lang.to_pylist()]
        n, s1, s2, gn, g1, g2, pn, p1 = (np.zeros(len(langs), np.int64 if f in ("n", "gn", "pn") else np.float64) for f in FIELDS)
        for lo, hi in slices(off, STEP):
            part, at = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
            key, first = grams(part, at)
            doc = np.repeat(np.arange(lo, hi), np.diff(first))
            pn[lo:hi], p1[lo:hi] = repeated_pairs(part, at)
            gap, first = gaps(part, at)
            gap_doc = np.repeat(np.arange(hi - lo), np.diff(first))
            code = np.array([hash(x) for x in langs[lo:hi]])
            for g in set(langs[lo:hi]):
                mine = np.flatnonzero((code == hash(g))[doc - lo])
                model = language(path, g)
                if not model:
                    continue
                lp = log_probs(key[mine], model)
                d = doc[mine] - lo
                s1[lo:hi] += np.bincount(d, lp, hi - lo)
                s2[lo:hi] += np.bincount(d, lp * lp, hi - lo)
                n[lo:hi] += np.bincount(d, minlength=hi - lo)
                if GAP in model:
                    mine = np.flatnonzero((code == hash(g))[gap_doc])
                    lp, d = np.maximum(np.nan_to_num(model[GAP].get(gap[mine]).astype(np.float64), nan=RARE), RARE), gap_doc[mine]
                    g1[lo:hi] += np.bincount(d, lp, hi - lo)
                    g2[lo:hi] += np.bincount(d, lp * lp, hi - lo)
                    gn[lo:hi] += np.bincount(d, minlength=hi - lo)
        empty = np.diff(off) == 0
        return pa.StructArray.from_arrays([pa.array(x) for x in (np.where(empty, 0, n), s1, s2, gn, g1, g2, pn, p1)], FIELDS)

    return arrow_udf(score, T.StructType([T.StructField(f, T.LongType() if f in ("n", "gn", "pn") else T.DoubleType()) for f in FIELDS]))


def perplexity(docs: DataFrame, width: float = 4.0, slack: float = 3.0) -> DataFrame:
    """doc_id, lang, perplexity, low, high (the band), rejected: a row for each row of docs."""
    work = Work(docs.sparkSession, "perplexity")
    path = fit(docs, work)
    x = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), scorer(path)(F.col("text"), F.col("lang")).alias("r"))
    n, gn, pn = (F.when(F.col(f"r.{c}") > 0, F.col(f"r.{c}")) for c in ("n", "gn", "pn"))
    x = x.select("doc_id", "lang", n.alias("n"), (-F.col("r.s1") / n).alias("x"), (F.col("r.s2") / n).alias("y"), gn.alias("gn"), (-F.col("r.g1") / gn).alias("gx"), (F.col("r.g2") / gn).alias("gy"), pn.alias("pn"), (F.col("r.p1") / pn).alias("px"))
    x = work.cut(x.withColumn("py", F.lit(0.25) + F.col("px") * F.col("px")))  # a share varies by 1/4 at most
    for a, long in (("", LONG), ("g", LONG_GAPS), ("p", LONG_GAPS)):
        x = banded(x, a, long, slack)
    low, high = F.col("mid") - width * F.col("s"), F.col("mid") + width * F.col("s")
    # Bernstein's bound: few values, some of them rare, are not near normal
    far = {"g": -RARE * width * width / 6, "p": width * width / 6}
    over = [F.coalesce(F.col(f"{a}x") > F.col(f"{a}mid") + width * F.col(f"{a}s") + v / F.col(f"{a}n"), F.lit(False)) for a, v in far.items()]
    out = F.coalesce((F.col("x") < low) | (F.col("x") > high), F.lit(False)) | over[0] | over[1]
    return x.select("doc_id", "lang", F.round(F.exp("x"), 6).alias("perplexity"), F.round(F.exp(low), 6).alias("low"), F.round(F.exp(high), 6).alias("high"), out.alias("rejected"))


def banded(x: DataFrame, a: str, least: int, slack: float) -> DataFrame:
    """Adds the language's median of the score ``a``x as ``a``mid and the text's standard error as ``a``s. ``a``n counts what is averaged, ``a``y is the mean square, ``least`` the count of a longer text."""
    n, v, y = F.col(f"{a}n"), F.col(f"{a}x"), F.col(f"{a}y")
    mid = x.groupBy("lang").agg(F.coalesce(F.percentile_approx(F.when(n >= least, v), 0.5, 10_000), F.percentile_approx(v, 0.5, 10_000)).alias(f"{a}mid"), F.avg(y - v * v).alias("tau2"))
    mad = x.join(F.broadcast(mid), "lang").groupBy("lang").agg(F.coalesce(F.percentile_approx(F.when(n >= least, F.abs(v - F.col(f"{a}mid"))), 0.5, 10_000), F.lit(0.0)).alias("mad"))
    band = mid.join(mad, "lang")  # a row for each language
    s = F.sqrt(F.pow(1.4826 * F.col("mad"), 2) + slack * F.col("tau2") / n)
    return x.join(F.broadcast(band), "lang").withColumn(f"{a}s", s).drop("mad", "tau2")
