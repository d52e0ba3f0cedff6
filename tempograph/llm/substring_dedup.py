"""Repeated passages by unit hashing: normalise, digest, keep the earliest ranked occurrence of each digest, remove the rest.

A line of one document may be wrapped otherwise in another, or a passage put into the middle of a line, so a unit is a line
whose borders come from the content: it ends after a word before a sentence mark (unless the word before it ends a sentence
too), and after a word whose MD5 begins with 0 or 1 (unless the same word stands before it), wherever the line breaks are.
Words are runs of ASCII letters and digits and of other non-ASCII characters; a character of a script without spaces (U+0E00 to
U+0EFF, U+3000 to U+D7FF) is a word of its own. Normalised are letter case, white space and marks. Digests have 64 bits:
one unit alone decides nothing, since only runs of consecutive repeated units with ``min_words`` words together are removed;
phrases that recur by chance stay.

Rank is the doc_id, then the place in the document. A unit is repeated if it stood in the document before, or stands in a document
with a smaller doc_id. The earliest is found by an aggregation of two longs with map-side partial results, so a unit that half of
the corpus carries moves one row per map task; only digests of two documents or more are joined back, where skewed ones are split.

Defined results: null and empty texts stay as they are. A null doc_id ranks last. Rows with the same doc_id don't take units from
each other (equal ones get the same decision); nor do rows with a null one. Offsets are in characters of the original text, half
open; a removed run ends where the next kept word begins. Extra columns, whatever their names, pass through ``drop_repeats`` and
are not in ``substring_dedup``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.functions import arrow_udf

from .common import _WORD, U64, mix, powers, release, slices, span_hash, utf8

STEP = 1 << 20
_MARK = np.zeros(256, np.int8)
_MARK[[33, 46, 63]] = 1
UNIT = T.ArrayType(T.StructType([T.StructField("u", T.LongType()), T.StructField("i", T.IntegerType()), T.StructField("r", T.BooleanType())]))


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words: start, end, and the first word's index for each text (n + 1 of them)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    word = _WORD[data]
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    at = off[:-1][off[:-1] < len(data)]
    begin[at] = word[at]
    solo = (data >= 0xE3) & (data <= 0xED)
    thai = np.flatnonzero(data[:-1] == 0xE0)
    solo[thai[(data[thai + 1] >= 0xB8) & (data[thai + 1] <= 0xBB)]] = True
    solo = np.flatnonzero(solo)
    begin[solo] = True
    after = solo + 3
    after = after[after < len(data)]
    begin[after] = word[after]
    stop = word.copy()
    stop[:-1] &= ~word[1:] | begin[1:]
    stop[off[1:][off[1:] > off[:-1]] - 1] = word[off[1:][off[1:] > off[:-1]] - 1]
    start = np.flatnonzero(begin)
    return start, np.flatnonzero(stop) + 1, np.searchsorted(start, off)


class Units:
    """Units of texts: words ``start`` in bytes of the text, each unit's first word ``head``, number of words ``n``, digest ``u``, and the first unit's index for each text ``of``."""

    def __init__(self, text: pa.Array, data: np.ndarray, off: np.ndarray):
        low, loff = utf8(pc.utf8_lower(text))
        self.start, end, first = tokens(data, off)
        if len(low) == len(data) and np.array_equal(loff, off):
            h = span_hash(low, self.start, end)
            at, to = self.start, end
        else:
            at, to, _ = tokens(low, loff)
            h = span_hash(low, at, to)
        m, n = len(h), len(off) - 1
        if not m:
            self.head, self.n, self.u, self.of = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(n + 1, np.int64)
            return
        _, one, inv = np.unique(h, return_index=True, return_inverse=True)
        raw = low.tobytes()
        few = np.fromiter((hashlib.md5(raw[a:b], usedforsecurity=False).digest()[0] < 32 for a, b in zip(at[one].tolist(), to[one].tolist(), strict=True)), bool, len(one))
        new = np.zeros(m, bool)
        new[first[:-1][first[1:] > first[:-1]]] = True
        last = np.append(new[1:], True)
        marks = np.concatenate([[0], np.cumsum(_MARK[data])])
        text_of = np.repeat(np.arange(n), np.diff(first))
        nxt = np.where(last, off[text_of + 1], np.append(self.start[1:], 0))
        ends = marks[nxt] > marks[end]
        border = last | (few[inv] & (new | (h != np.append(U64(0), h[:-1])))) | (ends & (new | ~np.append(False, ends[:-1])))
        self.head = np.concatenate([[0], np.flatnonzero(border)[:-1] + 1])
        self.n = np.diff(np.append(self.head, m))
        rel = np.arange(m) - np.repeat(self.head, self.n)
        with np.errstate(over="ignore"):
            self.u = mix(np.add.reduceat(h * powers(int(self.n.max()) + 1)[rel], self.head) ^ (self.n.astype(U64) << U64(48)))
        self.of = np.searchsorted(self.head, first)


def _steps(text: pa.Array):
    """Units of the texts some at a time: (first row, past the last, their bytes, offsets, units)."""
    data, off = utf8(text)
    for lo, hi in slices(off, STEP):
        part, at = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        yield lo, hi, part, at, Units(text.slice(lo, hi - lo).fill_null(""), part, at)


def _digests(text: pa.Array) -> pa.Array:
    """For each text its units: digest, number, and whether the unit stood in the text before."""
    release()
    u, i, r, count = [np.zeros(0, U64)], [np.zeros(0, np.int32)], [np.zeros(0, bool)], [np.zeros(1, np.int64)]
    for _, _, _, _, x in _steps(text):
        size = np.diff(x.of)
        doc = np.repeat(np.arange(len(size)), size)
        with np.errstate(over="ignore"):
            one = np.unique(mix(x.u + mix(doc.astype(U64))), return_index=True)[1]
        again = np.ones(len(doc), bool)
        again[one] = False
        u.append(x.u)
        i.append((np.arange(len(doc)) - x.of[doc]).astype(np.int32))
        r.append(again)
        count.append(size)
    items = pa.StructArray.from_arrays([pa.array(np.concatenate(u).view(np.int64)), pa.array(np.concatenate(i)), pa.array(np.concatenate(r))], ["u", "i", "r"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate(count).cumsum().astype(np.int32)), items)


def removals(docs: DataFrame) -> DataFrame:
    """(id, t, gone): the numbers of the repeated units of each document that has some."""
    unit = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("x")).where(F.length("x") > 0)
    unit = unit.select("id", F.xxhash64("x").alias("t"), F.explode(arrow_udf(_digests, UNIT)("x")).alias("s")).select("id", "t", "s.u", "s.i", "s.r")
    occ = unit.where("not r").drop("r")
    first = occ.groupBy("u").agg(F.min("id").alias("f"), F.max("id").alias("l"), F.count("*").alias("c"), F.count("id").alias("k"))
    first = first.where("f < l or (f is not null and c > k)").select("u", "f")
    again = occ.join(first, "u").where("id is null or id > f").select("id", "t", "i")
    again = again.unionByName(unit.where("r").select("id", "t", "i"))
    return again.groupBy("id", "t").agg(F.collect_set("i").alias("gone"))


def _marked(docs: DataFrame) -> DataFrame:
    """docs as one struct column d, with ``gone`` (null where nothing is repeated)."""
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"))
    gone = removals(docs)
    return d.join(gone, d["d.doc_id"].eqNullSafe(gone["id"]) & (F.xxhash64("d.text") == gone["t"]), "left").select("d", "gone")


_CUT = [("t", pa.string()), ("k", pa.string()), ("n", pa.int32())]


def _cutter(min_words: int):
    def cut(text: pa.Array, gone: pa.Array) -> pa.Array:
        """The text without its runs of repeated units, the kept spans as '0-17,40-88', and the number of units removed; null where that is 0."""
        release()
        out: list = [None] * len(text)
        goff = gone.offsets.to_numpy().astype(np.int64)
        flat, null = gone.values.to_numpy(zero_copy_only=False), gone.is_null().to_numpy(zero_copy_only=False)
        for lo, hi, data, off, x in _steps(text):
            size = np.diff(x.of)
            rep = np.zeros(len(x.u), bool)
            for d in range(hi - lo):
                if not null[lo + d]:
                    rep[x.of[d] + flat[goff[lo + d] : goff[lo + d + 1]]] = True
            doc = np.repeat(np.arange(hi - lo), size)
            new = np.ones(len(rep), bool)
            new[1:] = (rep[1:] != rep[:-1]) | (doc[1:] != doc[:-1])
            runs = np.flatnonzero(new)
            if not len(runs):
                continue
            drop = rep[runs] & (np.add.reduceat(x.n, runs) >= min_words)
            ends = np.append(runs[1:], len(rep))
            raw = data.tobytes()
            chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            spans: dict[int, list] = {}
            for a, b in zip(runs[drop].tolist(), ends[drop].tolist(), strict=True):
                d = int(doc[a])
                to = int(x.start[x.head[b]]) if b < x.of[d + 1] else int(off[d + 1])
                spans.setdefault(d, []).append((int(x.start[x.head[a]]), to, b - a))
            for d, cuts in spans.items():
                at, keep = int(off[d]), []
                for a, b, _ in cuts:
                    if a > at:
                        keep.append((at, a))
                    at = b
                if at < off[d + 1]:
                    keep.append((at, int(off[d + 1])))
                zero = int(chars[off[d]])
                out[lo + d] = {"t": b"".join(raw[a:b] for a, b in keep).decode(), "k": ",".join(f"{int(chars[a]) - zero}-{int(chars[b]) - zero}" for a, b in keep), "n": sum(c[2] for c in cuts)}
        return pa.array(out, pa.struct(_CUT))

    return arrow_udf(cut, T.StructType([T.StructField("t", T.StringType()), T.StructField("k", T.StringType()), T.StructField("n", T.IntegerType())]))


def _with_cut(docs: DataFrame, min_words: int) -> DataFrame:
    """Only texts with repeated units go to Python. ``c`` is null where nothing is removed."""
    x = _marked(docs)
    return x.withColumn("c", _cutter(min_words)(F.when(F.col("gone").isNotNull(), F.col("d.text")), F.col("gone")))


def substring_dedup(docs: DataFrame, min_words: int = 30) -> DataFrame:
    """doc_id, text without its repeats, n_removed (units), kept: a row for each row of docs. Where nothing goes, kept is the whole text."""
    x = _with_cut(docs.select("doc_id", "text"), min_words)
    text, some = F.col("d.text"), F.col("c").isNotNull()
    whole = F.when(F.length(text) > 0, F.concat(F.lit("0-"), F.length(text).cast("string"))).otherwise("")
    return x.select(F.col("d.doc_id").alias("doc_id"), F.when(some, F.col("c.t")).otherwise(text).alias("text"), F.when(some, F.col("c.n")).otherwise(0).cast("int").alias("n_removed"), F.when(some, F.col("c.k")).otherwise(whole).alias("kept"))


def drop_repeats(docs: DataFrame, min_words: int = 30) -> DataFrame:
    """docs with repeats cut out of text and n_chars set to match; a document of which nothing is left goes."""
    some = F.col("c").isNotNull()
    x = _with_cut(docs, min_words).where(~some | (F.length(F.trim("c.t")) > 0))
    cols = []
    for f in docs.schema:
        c = F.col("d").getField(f.name)
        if f.name == "text":
            c = F.when(some, F.col("c.t")).otherwise(c)
        elif f.name == "n_chars":
            c = F.when(some, F.length("c.t")).otherwise(c).cast(f.dataType)
        cols.append(c.alias(f.name))
    return x.select(*cols)


_SOLO = r"\x{0E00}-\x{0EFF}\x{3000}-\x{D7FF}"
SQL = rf"""
WITH x AS (
  SELECT doc_id, text, regexp_extract_all(text, '[{_SOLO}]|[0-9A-Za-z\x{{80}}-\x{{DFF}}\x{{F00}}-\x{{2FFF}}\x{{D800}}-\x{{10FFFF}}]+|[\x00-/:-@\[-`\{{-\x7f]+') AS k
  FROM documents WHERE length(text) > 0),
tok AS (SELECT doc_id, unnest(k) AS k, generate_subscripts(k, 1) AS p FROM x),
pos AS (SELECT *, sum(length(k)) OVER (PARTITION BY doc_id ORDER BY p) - length(k) AS s, regexp_matches(k, '^[\x00-/:-@\[-`\{{-\x7f]') AS gap,
    lead(k) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM tok),
w AS (SELECT doc_id, s, lower(k) AS w, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS j, coalesce(regexp_matches(g, '^[\x00-/:-@\[-`\{{-\x7f]') AND regexp_matches(g, '[.!?]'), false) AS e
  FROM pos WHERE NOT gap),
b AS (SELECT *, (md5(w) < '2' AND w IS DISTINCT FROM lag(w) OVER v) OR (e AND NOT coalesce(lag(e) OVER v, false)) AS b FROM w WINDOW v AS (PARTITION BY doc_id ORDER BY j)),
n AS (SELECT *, coalesce(sum(CAST(b AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS i FROM b),
u AS (SELECT doc_id, i, string_agg(w, ' ' ORDER BY j) AS u, count(*) AS n, min(s) AS s FROM n GROUP BY doc_id, i),
r AS (SELECT *, min(doc_id) OVER (PARTITION BY u) < doc_id OR row_number() OVER (PARTITION BY doc_id, u ORDER BY i) > 1 AS r FROM u),
isl AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - row_number() OVER (PARTITION BY doc_id, r ORDER BY i) AS isl FROM r),
d AS (SELECT *, r AND sum(n) OVER (PARTITION BY doc_id, r, isl) >= 30 AS gone, lead(s) OVER (PARTITION BY doc_id ORDER BY i) AS z FROM isl),
sp AS (
  SELECT doc_id, s, coalesce(z, length(text)) AS z, gone FROM d JOIN x USING (doc_id)
  UNION ALL SELECT doc_id, 0, min(s), false FROM d GROUP BY doc_id HAVING min(s) > 0),
k AS (SELECT *, sum(CAST(gone AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY s) AS g FROM sp),
m AS (SELECT doc_id, g, CAST(min(s) AS BIGINT) AS s, CAST(max(z) AS BIGINT) AS z FROM k WHERE NOT gone GROUP BY doc_id, g),
f AS (SELECT doc_id, string_agg(s || '-' || z, ',' ORDER BY s) AS kept, string_agg(substr(text, s + 1, z - s), '' ORDER BY s) AS t FROM m JOIN x USING (doc_id) GROUP BY doc_id),
c AS (SELECT doc_id, sum(CAST(gone AS INTEGER)) AS c FROM d GROUP BY doc_id)
SELECT o.doc_id, CASE WHEN coalesce(c, 0) > 0 THEN coalesce(t, '') ELSE o.text END AS text, CAST(coalesce(c, 0) AS INTEGER) AS n_removed,
  CASE WHEN coalesce(c, 0) > 0 THEN coalesce(kept, '') WHEN length(o.text) > 0 THEN '0-' || length(o.text) ELSE '' END AS kept
FROM documents o LEFT JOIN c USING (doc_id) LEFT JOIN f USING (doc_id)
"""
