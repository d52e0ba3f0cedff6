"""Full-text retrieval: term statistics in the scan, Okapi BM25, phrases, persistent postings."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.functions import arrow_udf

from ..work import Work

K1, B = 1.2, 0.75
TOKEN = r"[\p{L}\p{N}]+"
#: A postings table is joined by broadcast only up to this many query terms.
MAX_TERMS = 1000
#: A phrase's or a field's share of work: what a query may hold.
BUCKETS = 256


def _single() -> tuple[str, str]:
    """Letters and digits that compatibility composition without accents maps to one ASCII letter or digit, and those."""
    src, dst = [], []
    for c in map(chr, [*range(0xAA, 0x250), *range(0x1E00, 0x1F00), *range(0x2070, 0x2100), *range(0x2460, 0x2500), *range(0xFF01, 0xFF5F)]):
        x = "".join(y for y in unicodedata.normalize("NFKD", c.lower()) if not unicodedata.combining(y))
        if len(x) == 1 and x.isascii() and x.isalnum():
            src.append(c)
            dst.append(x)
    return "".join(src), "".join(dst)


FROM, TO = _single()


def fold(c: Column) -> Column:
    """Lower case without accents; compatibility forms of single letters and digits as those. An expression, so it stays in the JVM."""
    return F.translate(F.regexp_replace(F.lower(c), r"\p{Mn}+", ""), FROM, TO)


def tokens(c: Column) -> Column:
    """Runs of letters and digits of any script, folded."""
    return F.regexp_extract_all(fold(c), F.lit(TOKEN), F.lit(0))


def query_words(query: str) -> list[str]:
    """A query's words, folded like a text's."""
    x = "".join(c for c in unicodedata.normalize("NFKD", query.lower()) if not unicodedata.combining(c))
    return re.findall(r"[^\W_]+", x)


def query_terms(query: str) -> list[str]:
    """Terms of a free query, each once: what lies between characters that no identifier has; one with marks inside becomes a phrase. None: nothing matches."""
    found = re.findall(r"[\w./:@-]+", unicodedata.normalize("NFKC", query))
    return list(dict.fromkeys(w for w in (" ".join(query_words(x)) for x in found) if w))


def _frequency(t: Column, term: str) -> Column:
    return F.size(F.filter(t, lambda w: w == term))


def _phrase_frequency(t: Column, words: list[str]) -> Column:
    """Occurrences of adjacent words, overlapping ones too."""
    n = len(words)
    at = F.sequence(F.lit(1), F.greatest(F.size(t) - n + 1, F.lit(1)))
    hit = F.filter(at, lambda i: reduce(lambda a, b: a & b, [F.get(t, i + (k - 1)) == w for k, w in enumerate(words)]))
    return F.when(F.size(t) >= n, F.size(hit)).otherwise(0)


def _idf(n: Column, df: Column) -> Column:
    return F.greatest(F.lit(1e-6), F.log((n - df + 0.5) / (df + 0.5)))


def bm25(docs: DataFrame, id_col: str, text: Column, query: list[str], limit: int | None = 20, keep: list[str] = ()) -> DataFrame:
    """id, score (negative, smaller is better), hits: documents with any of the terms. A term of several words is a phrase.

    Frequencies of the query's terms are taken in the scan, so no postings are shuffled; one row of statistics is
    joined back. A document without a term has no score, and is left out by that: a filter on the frequencies would be
    pushed below the projection that tokenizes, and tokenize again for each term. The top rows come from TakeOrderedAndProject.
    """
    split = [w for w in map(query_words, query) if w]
    if not split:
        return docs.select(id_col, *keep, F.lit(0.0).alias("score"), F.lit(0).alias("hits")).limit(0)
    base = docs.select(F.col(id_col), *keep, tokens(text).alias("_t"))
    tf = [(_frequency(F.col("_t"), w[0]) if len(w) == 1 else _phrase_frequency(F.col("_t"), w)).alias(f"_f{i}") for i, w in enumerate(split)]
    base = base.select(id_col, *keep, F.size("_t").alias("_len"), *tf)
    stats = base.agg(F.count("*").alias("_n"), F.avg("_len").alias("_avg"), *[F.sum((F.col(f"_f{i}") > 0).cast("long")).alias(f"_d{i}") for i in range(len(split))])
    part = lambda i: _idf(F.col("_n"), F.col(f"_d{i}")) * (F.col(f"_f{i}") * (K1 + 1)) / (F.col(f"_f{i}") + K1 * (1 - B + B * F.col("_len") / F.col("_avg")))
    hits = reduce(lambda a, b: a + b, [(F.col(f"_f{i}") > 0).cast("int") for i in range(len(split))])
    score = F.when(hits > 0, F.round(-reduce(lambda a, b: a + b, [part(i) for i in range(len(split))]), 6))
    out = base.crossJoin(F.broadcast(stats)).select(id_col, *keep, score.alias("score"), hits.alias("hits")).where("score is not null")
    return out.orderBy("score", id_col).limit(limit) if limit else out


def fold_sql(c: str) -> str:
    return f"strip_accents(lower({c}))"


def bm25_sql(table: str, id_col: str, text: str, query: list[str], limit: int | None, keep: str = "") -> str:
    """The same in DuckDB, for single terms and phrases."""
    freq = []
    for i, q in enumerate(query):
        w = query_words(q)
        if len(w) == 1:
            freq.append(f"len(list_filter(t, lambda x: x = '{w[0]}')) AS f{i}")
        else:
            cond = " AND ".join(f"t[i + {k}] = '{x}'" for k, x in enumerate(w))
            freq.append(f"len(list_filter(range(1, len(t) - {len(w) - 2}), lambda i: {cond})) AS f{i}")
    n = len(query)
    k = f", {keep}" if keep else ""
    part = " + ".join(f"greatest(1e-6, ln((n - d{i} + 0.5) / (d{i} + 0.5))) * (f{i} * 2.2) / (f{i} + 1.2 * (1 - 0.75 + 0.75 * len / av))" for i in range(n))
    tail = f"ORDER BY score, {id_col} LIMIT {limit}" if limit else ""
    return f"""
    WITH a AS (SELECT {id_col}{k}, regexp_extract_all({fold_sql(text)}, '{TOKEN}') AS t FROM {table}),
    b AS (SELECT {id_col}{k}, len(t) AS len, {', '.join(freq)} FROM a),
    s AS (SELECT count(*) AS n, avg(len) AS av, {', '.join(f'sum(CASE WHEN f{i} > 0 THEN 1 ELSE 0 END) AS d{i}' for i in range(n))} FROM b)
    SELECT {id_col}{k}, round(-({part}), 6) AS score, CAST({' + '.join(f'(CASE WHEN f{i} > 0 THEN 1 ELSE 0 END)' for i in range(n))} AS INTEGER) AS hits
    FROM b, s WHERE {' OR '.join(f'f{i} > 0' for i in range(n))} {tail}"""


@arrow_udf(T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("positions", T.ArrayType(T.IntegerType()))])))
def grouped(words: pa.Array) -> pa.Array:
    """Of each list of words, every word with its positions, counted from 1. Some lists at a time, by sorting numbers of words."""
    out = []
    for at in range(0, len(words), 256):
        part = words.slice(at, 256)
        n = pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = pc.dictionary_encode(pc.list_flatten(part))
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(part)), n)
        pos = np.arange(len(codes)) - (np.cumsum(n) - n)[row] + 1
        key = row * max(1, len(coded.dictionary)) + codes
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        positions = pa.ListArray.from_arrays(pa.array(np.append(first, len(key)), pa.int32()), pa.array(pos[order], pa.int32()))
        items = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(codes[order][first])).cast(pa.string()), positions], ["term", "positions"])
        terms = np.bincount(row[order][first], minlength=len(part))
        out.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(terms)), pa.int32()), items))
    return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.struct([("term", pa.string()), ("positions", pa.list_(pa.int32()))])))


def postings(docs: DataFrame, id_col: str, fields: dict[str, Column]) -> DataFrame:
    """(id, field, term, positions, bucket): an index to write partitioned by bucket, so that a query reads its terms only. A document's terms are grouped in its own row: nothing is shuffled."""
    parts = []
    for f, c in fields.items():
        # outer: explode would infer a filter on the array, and that one be pushed below, so that all of it is done twice
        x = docs.select(F.col(id_col), F.explode_outer(grouped(tokens(c))).alias("_i"))
        parts.append(x.select(id_col, F.lit(f).alias("field"), "_i.*").where("term is not null"))
    return reduce(DataFrame.unionByName, parts).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)))


def field_lengths(docs: DataFrame, id_col: str, fields: dict[str, Column]) -> DataFrame:
    """(id, len): words of all fields together."""
    return docs.select(F.col(id_col), reduce(lambda a, b: a + b, [F.greatest(F.size(tokens(c)), F.lit(0)) for c in fields.values()]).alias("len"))


def indexed_lengths(index: DataFrame, docs: DataFrame, id_col: str) -> DataFrame:
    """field_lengths() from a postings table of these documents: no text is read again."""
    n = index.groupBy(id_col).agg(F.sum(F.size("positions")).alias("len"))
    return docs.select(id_col).join(n, id_col, "left").select(id_col, F.coalesce("len", F.lit(0)).alias("len"))


def search_postings(index: DataFrame, lengths: DataFrame, id_col: str, query: list[str], limit: int | None = 20, weights: dict[str, float] | None = None) -> DataFrame:
    """id, score, hits: BM25 from a postings table; only the buckets of the query's terms are read. A term of several words is a phrase: its words stand next to each other in one field. weights: what an occurrence in a field counts (1)."""
    terms = [w for w in map(query_words, dict.fromkeys(query)) if w]
    words = sorted({w for t in terms for w in t})
    if len(words) > MAX_TERMS:
        raise ValueError(f"at most {MAX_TERMS} terms")
    spark = index.sparkSession
    rows = [(i, j, w) for i, t in enumerate(terms) for j, w in enumerate(t)]
    wanted = spark.createDataFrame(rows, "q int, j int, term string")
    buckets = [r.b for r in wanted.select(F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).alias("b")).distinct().collect()]  # at most BUCKETS
    hit = index.where(F.col("bucket").isin(buckets)).join(F.broadcast(wanted), "term")
    size = spark.createDataFrame([(i, len(t)) for i, t in enumerate(terms)], "q int, n int")
    weight = F.coalesce(*[F.when(F.col("field") == f, F.lit(float(v))) for f, v in (weights or {}).items()], F.lit(1.0))
    one = hit.join(F.broadcast(size.where("n = 1")), "q").select(id_col, "q", (F.size("positions") * weight).alias("f"))
    more = hit.join(F.broadcast(size.where("n > 1")), "q").select(id_col, "q", "n", "field", F.explode("positions").alias("p"), "j")
    more = more.groupBy(id_col, "q", "n", "field", (F.col("p") - F.col("j")).alias("at")).agg(F.count("*").alias("c")).where("c = n").select(id_col, "q", weight.alias("f"))
    tf = one.unionByName(more).groupBy(id_col, "q").agg(F.sum("f").alias("f"))
    tf = Work(spark, "search").cut(tf)  # read twice; the index is searched once
    df = tf.groupBy("q").agg(F.count("*").alias("d"))
    stats = lengths.agg(F.count("*").alias("n"), F.avg("len").alias("av"))
    x = tf.join(F.broadcast(df), "q").join(lengths, id_col).crossJoin(F.broadcast(stats))
    s = _idf(F.col("n"), F.col("d")) * (F.col("f") * (K1 + 1)) / (F.col("f") + K1 * (1 - B + B * F.col("len") / F.col("av")))
    out = x.groupBy(id_col).agg(F.round(-F.sum(s), 6).alias("score"), F.count("*").cast("int").alias("hits"))
    return out.orderBy("score", id_col).limit(limit) if limit else out
