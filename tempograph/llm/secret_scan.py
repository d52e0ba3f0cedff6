"""Secrets by a battery of randomness tests with false-discovery control.

Candidates are maximal runs of at least ``min_len`` characters from [A-Za-z0-9+/_-] that hold a digit, or both letter
cases, and aren't digits alone (numbers are no secrets). The smallest alphabet that holds a candidate is its encoding:
hex, base32, base36 (one letter case and digits), base62, base64url, base64.

Battery, each against the hypothesis that the string is ordinary text of that encoding (letters by their frequency in the
corpus, digits in runs), with the moments for its length: the chi-squared statistic against a uniform alphabet (ordinary
text deviates more), the number of runs of the same class (letter or digit, and letter case; ordinary text has fewer),
and the serial correlation of class membership (ordinary text has more). Each gives a z-value, negative for
random strings; p is that of their mean, which holds however they depend on each other. A string that a two-sided uniformity test rejects as random
at ``uniform_min`` has p = 1.

Length-aware control: weighted Benjamini-Hochberg over every candidate of the corpus. A candidate's weight is proportional
to its length, with mean 1, since longer strings carry more evidence. p over weight is rounded up to 1/64 of a
natural logarithm, so the table from which the cutoff comes has a bounded number of rows, whatever the corpus.

Defined results: null and empty texts have no secret. Repeated rows and repeated strings are tests of their own (ties have
equal values and get the same decision). Null doc_ids are scanned. An empty table has no discoveries. Extra columns,
whatever their names, pass through ``redact``.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.functions import arrow_udf

from .common import Work, release, utf8

RUN = r"[A-Za-z0-9+/_\-]{%d,}"
#: What makes a run a candidate, for the JVM and for Python alike.
MIXED = r"[0-9].*[A-Za-z]|[A-Za-z].*[0-9]|[a-z].*[A-Z]|[A-Z].*[A-Z].*[a-z]"
STEP = 64.0
ENCODINGS = {"hex": (re.compile(r"[0-9a-f]+|[0-9A-F]+"), 16), "base32": (re.compile(r"[A-Z2-7]+"), 32), "base36": (re.compile(r"[0-9a-z]+|[0-9A-Z]+"), 36), "base62": (re.compile(r"[0-9A-Za-z]+"), 62), "base64url": (re.compile(r"[0-9A-Za-z_\-]+"), 64), "base64": (re.compile(r"[0-9A-Za-z+/_\-]+"), 66)}


def encoding(s: str) -> str:
    return next(k for k, (r, _) in ENCODINGS.items() if r.fullmatch(s))


def p_values(strings: list[str], letters: np.ndarray, uniform_min: float = 1e-5) -> tuple[list[str], np.ndarray]:
    """Encodings and combined p-values; letters: the corpus' frequencies of a to z."""
    enc, out = [], np.ones(len(strings))
    z = np.zeros((len(strings), 3))
    for i, s in enumerate(strings):
        e = encoding(s)
        enc.append(e)
        k, n = ENCODINGS[e][1], len(s)
        # ordinary text of this encoding: letters as in the corpus, within the encoding's letters; a tenth are digits
        q = letters[:6] if e == "hex" else letters
        q = q / q.sum()
        p = np.concatenate([q * 0.9, np.full(10, 0.01)])
        s2, s3 = (p**2).sum(), (p**3).sum()
        expect = k * ((n - 1) * s2 + 1) - n
        var = k * k * (n - 1) / n * (4 * (n - 2) * s3 + 2 * s2 - (4 * n - 6) * s2 * s2)
        counts = np.unique(np.frombuffer(s.encode(), np.uint8), return_counts=True)[1].astype(float)
        chi = k / n * (counts**2).sum() - n
        z[i, 0] = (chi - expect) / math.sqrt(max(var, 1e-9))
        u = (chi - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n)
        s = re.sub(r"[+/_\-]", "", s) or "a"  # separators make no runs
        n = max(len(s), 2)
        cls = np.array([0 if c.isdigit() else 1 if c.islower() else 2 for c in s])
        change = cls[1:] != cls[:-1]
        runs = 1 + int(change.sum())
        # ordinary text changes class at a rate of 1 in 12 (word, number, separator)
        rate = 1 / 12
        z[i, 1] = -(runs - 1 - (n - 1) * rate) / math.sqrt((n - 1) * rate * (1 - rate))
        x = (cls == cls.max()).astype(float) if cls.max() != cls.min() else np.zeros(len(cls))
        c0 = ((x - x.mean()) ** 2).sum()
        rho = ((x[1:] - x.mean()) * (x[:-1] - x.mean())).sum() / c0 if c0 > 0 else 1.0
        z[i, 2] = 0.0 if n < 4 else (rho - (1 - 2 * rate)) * math.sqrt(n) / math.sqrt(1 - (1 - 2 * rate) ** 2)
        flat = 0.5 * math.erfc(u / math.sqrt(2))
        if flat < uniform_min:
            z[i] = np.inf
    if not strings:
        return enc, out
    mean = np.clip(z, -1e3, 1e3).mean(axis=1)
    return enc, np.clip([0.5 * math.erfc(-x / math.sqrt(2)) for x in mean], 1e-15, 1.0)


def key(p: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """log of p over weight, in steps of 1/STEP, rounded up."""
    return np.ceil(np.log(np.maximum(p / weight, 1e-18)) * STEP).astype(np.int64)


def frequencies(docs: DataFrame) -> np.ndarray:
    """Frequencies of a to z over all texts, each letter with one count more."""

    def letters(text: pa.Array) -> pa.Array:
        release()
        n = np.zeros((len(text), 26), np.int64)
        data, _ = utf8(text)
        if len(text):
            n[0] = np.bincount(data, minlength=256)[97:123]
        return pa.FixedSizeListArray.from_arrays(pa.array(n.ravel()), 26).cast(pa.list_(pa.int64()))

    x = docs.select(arrow_udf(letters, T.ArrayType(T.LongType()))(F.lower("text")).alias("n"))
    r = x.agg(*[F.sum(F.col("n")[i]).alias(f"c{i}") for i in range(26)]).first()
    n = np.array([float(c or 0) for c in r]) + 1
    return n / n.sum()


def model(docs: DataFrame, min_len: int = 16, fdr: float = 0.01) -> dict:
    """What decides on a candidate: letter frequencies, mean length of the candidates and cutoff of the key, all from every row."""
    letters = frequencies(docs)
    runs = F.regexp_extract_all("text", F.lit(f"({RUN % min_len})"), F.lit(1))
    cand = docs.select(F.explode(F.filter(runs, lambda s: s.rlike(MIXED))).alias("s"))
    cand = Work(docs.sparkSession, "secrets").cut(cand)
    total = cand.agg(F.count("*").alias("m"), F.avg(F.length("s")).alias("mean")).first()
    if not total.m:
        return {"letters": letters, "mean": 1.0, "cutoff": None, "min_len": min_len}
    mean = float(total.mean)

    def keys(s: pa.Array) -> pa.Array:
        release()
        s = s.to_pylist()
        return pa.array(key(p_values(s, letters)[1], np.array([len(x) for x in s]) / mean))

    table = cand.select(arrow_udf(keys, T.LongType())("s").alias("k")).groupBy("k").count().collect()  # bounded by the steps of key
    seen, cutoff = 0, None
    for r in sorted(table):
        seen += r["count"]
        if math.exp(r.k / STEP) <= fdr * seen / total.m:
            cutoff = r.k
    return {"letters": letters, "mean": mean, "cutoff": cutoff, "min_len": min_len}


def scan_text(text: str, m: dict) -> list[dict]:
    """Every candidate of a text: start and end in characters, encoding, p-value, and whether it is a secret."""
    spans = [x.span() for x in re.finditer(RUN % m["min_len"], text) if re.search(MIXED, x.group())]
    if not spans:
        return []
    strings = [text[a:b] for a, b in spans]
    enc, p = p_values(strings, m["letters"])
    k = key(p, np.array([len(s) for s in strings]) / m["mean"])
    return [{"start": a, "end": b, "encoding": e, "p_value": float(f"{q:.6g}"), "secret": m["cutoff"] is not None and int(j) <= m["cutoff"]} for (a, b), e, q, j in zip(spans, enc, p, k, strict=True)]


_HIT = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("encoding", T.StringType()), T.StructField("p_value", T.DoubleType()), T.StructField("secret", T.BooleanType())])
_HITS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("encoding", pa.string()), ("p_value", pa.float64()), ("secret", pa.bool_())]))


def _with_run(text: Column, m: dict) -> Column:
    """Only texts with a long run go to Python."""
    return F.when(text.rlike(RUN % m["min_len"]), text)


def secret_scan(docs: DataFrame, m: dict) -> DataFrame:
    """doc_id, n_secrets, candidates (each with its offsets, encoding, p-value, decision): a row for each row of docs."""
    scan = arrow_udf(lambda t: pa.array([scan_text(x, m) if x else [] for x in t.to_pylist()], _HITS), T.ArrayType(_HIT))
    x = docs.select("doc_id", scan(_with_run(docs["text"], m)).alias("candidates"))
    return x.select("doc_id", F.size(F.filter("candidates", lambda h: h["secret"])).alias("n_secrets"), "candidates")


def redact(docs: DataFrame, m: dict, mark: str = "[SECRET]") -> DataFrame:
    """docs with each secret replaced by ``mark`` and n_chars set to match; no row goes."""

    def cut(text: pa.Array) -> pa.Array:
        release()
        out = []
        for x in text.to_pylist():
            hits = [h for h in scan_text(x, m) if h["secret"]] if x else []
            for h in reversed(hits):
                x = x[: h["start"]] + mark + x[h["end"] :]
            out.append(x if hits else None)
        return pa.array(out, pa.string())

    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"))
    d = d.withColumn("c", arrow_udf(cut, T.StringType())(_with_run(F.col("d.text"), m)))
    cols = []
    for f in docs.schema:
        c = F.col("d").getField(f.name)
        if f.name == "text":
            c = F.coalesce("c", c)
        elif f.name == "n_chars":
            c = F.when(F.col("c").isNotNull(), F.length("c")).otherwise(c).cast(f.dataType)
        cols.append(c.alias(f.name))
    return d.select(*cols)
