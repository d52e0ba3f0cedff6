"""Near-duplicate documents by Order MinHash with banded alignment.

Words (lower case, letters and digits) form k-mers of k words, each labelled with its occurrence number in its text. For
each of m hash functions the l smallest k-mers, in text order, make one value; its collision probability follows edit
similarity, as both the shared k-mers and their order count. Each of the m values is a band.

1. Documents with equal word sequences are one node, the smallest doc_id.
2. A bucket is a band's value shared by several nodes. Buckets of up to SMALL nodes give all their pairs; a crowded one
   gives each member's pair with its smallest node, which joins a family of copies of whatever size. Pairs whose lengths
   alone put them under the threshold are not candidates.
3. What is in a crowded bucket (a passage that many documents share puts them there) is searched exactly, whatever bands a
   pair shares: texts of n words within the edit distance have at least 0.6 n - 1 runs of two words in common, as an edit
   takes two away, so of the rarest 0.4 n + s runs (labelled by occurrence; one order for all) of two such texts s meet.
   Chance makes long texts of one language meet in a few, in pairs that grow with the square of the table; so s is a quarter
   of the runs in common, and pairs that meet in fewer are no candidates. Lists
   of these runs are compared in blocks: pairs of two groups whose lengths and word histograms allow the distance are
   counted. So no pair that shares a band is left out, none within a group is made, and SMALL only chooses the way.
4. Pairs are verified by the edit distance of the word sequences, at most (1 - threshold) * longer length: too few q-mers in
   common (q of 3, 2, 1) rule a pair out, an alignment along common 3-mers that is cheap enough lets it in, and what neither
   tells is aligned in a band that grows until it holds the distance. Pairs inside one group already need no verification: first each node's
   best pair, then each group's best pair, then all that still join two groups.
5. Groups are the connected components of the verified pairs, by alternating large-star and small-star.

Defined results: null texts, texts without a word and null doc_ids are in no group. Rows with the same doc_id are one
document if their words are equal; of several texts under one doc_id, any may link it. Ties go to the smallest doc_id.
An empty table gives no group. Extra columns, whatever their names, pass through ``keep_first``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T, Window as W
from pyspark.sql.functions import arrow_udf

from .common import U64, Work, mix, release, slices, utf8, words

SMALL = 8
ORDER = 2
#: Counters of the frequencies of runs of words, buckets of a text's word histogram, texts in a block.
COUNTERS = 1 << 18
HISTOGRAM = 128
#: Texts meet in one of so many of the runs that they have in common at least.
MEET = 4
BLOCK = 256
#: Bytes of text in a step, so that a step's arrays stay in a core's cache.
STEP = 1 << 18
FACTS = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("n", T.IntegerType()), T.StructField("bands", T.ArrayType(T.LongType()))])


def _occurrence(v: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """How many times each value stands earlier in its text."""
    at = np.arange(len(v))
    bits = U64(len(v).bit_length())
    key = np.sort(mix(v + doc.astype(U64) * U64(0xD1342543DE82EF95)) >> bits << bits | at.astype(U64))  # one word holds a hash and the place
    order = (key & ((U64(1) << bits) - U64(1))).astype(np.int64)
    key >>= bits
    new = np.ones(len(v), bool)
    new[1:] = key[1:] != key[:-1]
    sv, sd = v[order], doc[order]
    if (~new[1:] & ((sv[1:] != sv[:-1]) | (sd[1:] != sd[:-1]))).any():  # two values have one hash
        order = np.lexsort((v, doc))
        sv, sd = v[order], doc[order]
        new[1:] = (sv[1:] != sv[:-1]) | (sd[1:] != sd[:-1])
    occ = np.empty(len(v), U64)
    occ[order] = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(U64)
    return occ


def kmers(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Occurrence-labelled hashes of the k-mers, in text order, and each text's first index. A text of fewer than k words has one k-mer."""
    n = np.diff(first)
    count = np.where(n > 0, np.maximum(n - k + 1, 1), 0)
    start = np.concatenate([[0], np.cumsum(count)])
    doc = np.repeat(np.arange(len(n)), count)
    at = np.arange(start[-1]) - start[doc] + first[doc]
    with np.errstate(over="ignore"):
        v = np.zeros(start[-1], U64)
        for j in range(k):
            there = at + j < first[doc + 1] if len(doc) else np.zeros(0, bool)
            v = mix(v * U64(31) + np.where(there, h[np.minimum(at + j, max(len(h) - 1, 0))] if len(h) else 0, U64(j)))
        return mix(v + _occurrence(v, doc) * U64(0x9E3779B97F4A7C15)), start


def sketch(v: np.ndarray, start: np.ndarray, m: int) -> np.ndarray:
    """m values for each text that has a k-mer (in order): the two smallest under each hash function, in text order."""
    have = np.flatnonzero(np.diff(start) > 0)
    s = start[have]
    n = np.diff(start)[have]
    out = np.empty((len(have), m), U64)
    if not len(have):
        return out
    seeds = mix(np.arange(1, m + 1, dtype=U64) * U64(0xD1342543DE82EF95))
    text = np.repeat(np.arange(len(have)), n)
    full = U64(0xFFFFFFFFFFFFFFFF)
    x, high = np.empty_like(v), np.empty_like(v)

    def least() -> np.ndarray:
        hit = np.flatnonzero(x == np.repeat(np.minimum.reduceat(x, s), n))
        of = text[hit]
        return hit[np.concatenate([[True], of[1:] != of[:-1]])]

    with np.errstate(over="ignore"):
        for i in range(m):
            np.bitwise_xor(v, seeds[i], out=x)
            np.multiply(x, seeds[i] | U64(1), out=x)
            np.right_shift(x, U64(32), out=high)
            np.bitwise_xor(x, high, out=x)
            first = least()
            x[first] = full
            second = least()
            va, vb = v[first], np.where(n > 1, v[second], U64(0))
            swap = second < first
            out[:, i] = mix(mix(np.where(swap, vb, va)) + np.where(swap, va, vb) * U64(3) + U64(i))
    return out


def _facts(m: int, k: int):
    def facts(text: pa.Array) -> pa.Array:
        release()
        data, off = utf8(text)
        digests, counts, values, lens = [], [], [], []
        for lo, hi in slices(off, STEP):
            _, _, h, first = words(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            n = np.diff(first)
            v, start = kmers(h, first, k)
            values.append(sketch(v, start, m).ravel())
            lens.append(np.where(n > 0, m, 0))
            counts.append(n)
            raw = h.tobytes()
            digests += [hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() for a, b in zip(first[:-1], first[1:], strict=True)]
        lens = np.concatenate([[0], *lens]).cumsum().astype(np.int32)
        bands = pa.ListArray.from_arrays(pa.array(lens), pa.array(np.concatenate([np.zeros(0, U64), *values]).view(np.int64)))
        return pa.StructArray.from_arrays([pa.array(digests, pa.binary()), pa.array(np.concatenate([np.zeros(0, np.int64), *counts]).astype(np.int32)), bands], ["digest", "n", "bands"])

    return arrow_udf(facts, FACTS)


def _band(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray, t: int) -> np.ndarray:
    """Edit distances of padded rows within a band of t to either side; t + 1 where it is more."""
    n, width = len(la), 2 * t + 1
    big = np.int32(t + 1)
    d = np.arange(-t, t + 1, dtype=np.int32)
    cur = np.broadcast_to(np.where(d >= 0, d, big), (n, width)).astype(np.int32)
    pad = np.zeros((n, t), b.dtype)
    bp = np.concatenate([pad, b, np.zeros((n, t + max(0, a.shape[1] - b.shape[1]) + 1), b.dtype)], axis=1)
    j = np.arange(width, dtype=np.int32)
    out = np.full(n, big, np.int32)
    rows = np.arange(n)

    def take(i: int) -> None:
        done = la[rows] == i
        if done.any():
            at = (lb - la)[rows[done]] + t
            ok = (at >= 0) & (at < width)
            out[rows[done][ok]] = np.minimum(cur[np.flatnonzero(done)[ok], at[ok]], big)

    take(0)
    for i in range(1, a.shape[1] + 1):
        same = bp[:, i - 1 : i - 1 + width] == a[:, i - 1 : i]
        nxt = cur + ~same
        np.minimum(nxt[:, :-1], cur[:, 1:] + 1, out=nxt[:, :-1])
        col = i + d
        if i <= t:
            nxt[:, col == 0] = i
            nxt[:, col < 0] = big
        nxt -= j
        np.minimum.accumulate(nxt, axis=1, out=nxt)
        nxt += j
        cur = np.minimum(nxt, big)
        take(i)
        if i % 16 == 0:
            live = (cur.min(axis=1) <= t) & (la[rows] > i)
            if not live.any():
                break
            if live.sum() < 0.7 * len(rows):
                rows, cur, bp, a = rows[live], cur[live], bp[live], a[live]
    return out


def _met(hx: np.ndarray, fx: np.ndarray, hy: np.ndarray, fy: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The q-mers that pairs of texts have in common, by occurrence: pair, first word in x, first word in y."""
    (vx, sx), (vy, sy) = kmers(hx, fx, q), kmers(hy, fy, q)
    if not len(vx) or not len(vy):
        return (np.zeros(0, np.int64),) * 3
    px, py = (np.repeat(np.arange(len(s) - 1), np.diff(s)) for s in (sx, sy))
    with np.errstate(over="ignore"):
        kx, ky = (mix(v + p.astype(U64) * U64(0xD1342543DE82EF95)) for v, p in ((vx, px), (vy, py)))
    order = np.argsort(ky)
    ky = ky[order]
    at = np.minimum(np.searchsorted(ky, kx), len(ky) - 1)
    i = np.flatnonzero(ky[at] == kx)
    j = order[at[i]]
    same = px[i] == py[j]
    i, j = i[same], j[same]
    return px[i], i - sx[px[i]] + fx[px[i]], j - sy[py[j]] + fy[py[j]]


def _at_most(hx: np.ndarray, fx: np.ndarray, hy: np.ndarray, fy: np.ndarray, pair: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """An alignment's cost for each pair of texts, which the edit distance does not exceed: common places that cross no other are kept, and what is between two of them is laid side by side."""
    n = len(fx) - 1
    if len(p):
        before = np.concatenate([[-1], np.maximum.accumulate(q)[:-1]])
        after = np.concatenate([np.minimum.accumulate(q[::-1])[::-1][1:], [len(hy)]])
        keep = (q > before) & (q < after)
        pair, p, q = pair[keep], p[keep], q[keep]
    # a text's start is a place as well
    pair = np.concatenate([np.arange(n), pair])
    order = np.argsort(pair, kind="stable")
    pair, p, q = pair[order], np.concatenate([fx[:-1], p])[order], np.concatenate([fy[:-1], q])[order]
    last = np.concatenate([pair[1:] != pair[:-1], [True]])
    dx = np.where(last, fx[pair + 1], np.concatenate([p[1:], [0]])) - p
    dy = np.where(last, fy[pair + 1], np.concatenate([q[1:], [0]])) - q
    both = np.minimum(dx, dy)
    of = np.repeat(np.arange(len(p)), both)
    k = np.arange(len(of)) - np.repeat(np.cumsum(both) - both, both)
    left = np.bincount(of, hx[p[of] + k] != hy[q[of] + k], len(p))
    right = np.bincount(of, hx[(p + dx - both)[of] + k] != hy[(q + dy - both)[of] + k], len(p))
    return np.bincount(pair, np.minimum(left, right) + np.abs(dx - dy), n)


def _bounded(todo: list, res: np.ndarray) -> list:
    """Settles the pairs that bounds of the edit distance tell; the others are returned. One edit takes q q-mers away at most."""
    left, at = [], 0
    while at < len(todo):
        end, size = at, 0
        while end < len(todo) and (end == at or size + len(todo[end][1]) + len(todo[end][2]) <= 1 << 15):
            size += len(todo[end][1]) + len(todo[end][2])
            end += 1
        part = todo[at:end]
        at = end
        for q in (3, 2, 1):
            if not part:
                break
            fx, fy = (np.concatenate([[0], np.cumsum([len(r[k]) for r in part])]) for k in (1, 2))
            hx, hy = (np.concatenate([r[k] for r in part]) for k in (1, 2))
            limit = np.array([r[3] for r in part])
            pair, i, j = _met(hx, fx, hy, fy, q)
            open_ = np.bincount(pair, minlength=len(part)) >= np.maximum(np.diff(fx), np.diff(fy)) - (q - 1) - q * limit
            if q == 3:
                near = _at_most(hx, fx, hy, fy, pair, i, j) <= limit
                for r, x in zip(part, near, strict=True):
                    res[r[0]] = x
                open_ &= ~near
            part = [r for r, x in zip(part, open_, strict=True) if x]
        left += part
    return left


def within(pairs: list[tuple[np.ndarray, np.ndarray]], threshold: float, cells: int = 1 << 18) -> np.ndarray:
    """Whether each pair of sequences has edit similarity 1 - distance / longer length of at least threshold."""
    res = np.zeros(len(pairs), bool)
    todo = []
    for i, (x, y) in enumerate(pairs):
        limit = int((1 - threshold) * max(len(x), len(y)) + 1e-9)
        if abs(len(x) - len(y)) > limit:
            continue
        m = min(len(x), len(y))
        neq = np.flatnonzero(x[:m] != y[:m])
        p = int(neq[0]) if len(neq) else m
        x, y = x[p:], y[p:]
        m = min(len(x), len(y))
        neq = np.flatnonzero(x[len(x) - m :][::-1] != y[len(y) - m :][::-1])
        q = int(neq[0]) if len(neq) else m
        x, y = x[: len(x) - q], y[: len(y) - q]
        if not len(x) or not len(y):
            res[i] = len(x) + len(y) <= limit
        elif limit:
            todo.append((i, x, y, limit))
    todo = _bounded(todo, res)
    t = 4
    while todo:
        todo.sort(key=lambda r: len(r[1]))
        left, at = [], 0
        while at < len(todo):
            end, longest = at, 1
            while end < len(todo) and (end == at or (end - at + 1) * (2 * t + 1) <= cells and len(todo[end][1]) <= 2 * len(todo[at][1]) + 64):
                end += 1
            part = todo[at:end]
            at = end
            la, lb = (np.array([len(r[k]) for r in part], np.int64) for k in (1, 2))
            a, b = (np.zeros((len(part), n), U64) for n in (la.max(), lb.max()))
            for k, r in enumerate(part):
                a[k, : la[k]], b[k, : lb[k]] = r[1], r[2]
            dist = _band(a, la, b, lb, t)
            for r, x in zip(part, dist, strict=True):
                if x <= t:
                    res[r[0]] = x <= r[3]
                elif t < r[3]:
                    left.append(r)
        todo, t = left, t * 4
    return res


def _similar(threshold: float):
    def similar(x: pa.Array, y: pa.Array) -> pa.Array:
        release()
        res = np.zeros(len(x), bool)
        (dx, ox), (dy, oy) = utf8(x), utf8(y)
        for lo, hi in slices(ox + oy, STEP):
            _, _, hx, fx = words(dx[ox[lo] : ox[hi]], ox[lo : hi + 1] - ox[lo])
            _, _, hy, fy = words(dy[oy[lo] : oy[hi]], oy[lo : hi + 1] - oy[lo])
            res[lo:hi] = within([(hx[fx[i] : fx[i + 1]], hy[fy[i] : fy[i + 1]]) for i in range(hi - lo)], threshold)
        return pa.array(res)

    return arrow_udf(similar, T.BooleanType())


def components(work: Work, edges: DataFrame) -> DataFrame:
    """(id, g): each vertex of the edges (a, b) with the smallest vertex of its component; alternating stars, a written table each turn."""
    count = lambda t: t.agg(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count("*")).first()
    e = work.cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    was = count(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("lo")).select("u", F.least("u", "lo").alias("lo"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("lo").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("lo"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("lo"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("lo").alias("v")).where("u > v").distinct()
        nxt = work.cut(small)
        now = count(nxt)
        work.drop(e)
        e = nxt
        if now == was:
            return e.select(F.col("u").alias("id"), F.col("v").alias("g"))
        was = now


def groups(docs: DataFrame, threshold: float = 0.8, m: int = 20, k: int = 3) -> DataFrame:
    """(id, g): every document that has a near copy, with the smallest doc_id of its group (of which it is one)."""
    spark = docs.sparkSession
    work = Work(spark, "near")
    text = docs.select(F.col("doc_id").alias("id"), F.lower("text").alias("x")).where("id is not null and length(x) > 0")
    facts = text.select("id", _facts(m, k)("x").alias("f")).select("id", "f.*").where("n > 0")
    facts = work.cut(facts)
    node = facts.groupBy("digest").agg(F.min(F.struct("id", "n", "bands")).alias("r"))
    same = facts.select("id", "digest").join(node.select("digest", F.col("r.id").alias("g")), "digest").where("id <> g").select("id", "g").distinct()
    same = work.cut(same)
    node = work.cut(node.select("r.*"))
    work.drop(facts)
    rows = node.select(F.struct("id", "n").alias("d"), F.posexplode("bands").alias("band", "v"))
    rows = work.cut(_buckets(rows.select(F.xxhash64("band", "v").alias("key"), "d")))
    near = F.least("d.n", "q.n") >= F.greatest("d.n", "q.n") * threshold - 1e-6

    def candidates(buckets: DataFrame) -> DataFrame:
        q = F.explode(F.when(F.col("c") <= SMALL, F.col("p")).otherwise(F.array("s"))).alias("q")
        x = buckets.select("d", q).where("q is not null and q.id <> d.id").where(near)
        return x.groupBy(F.least("d.id", "q.id").alias("a"), F.greatest("d.id", "q.id").alias("b")).agg(F.count("*").alias("c"))

    pairs = work.cut(candidates(rows))
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id"), F.lit(False).alias("crowded")).unionByName(rows.where(F.col("c") > SMALL).select("d.id", F.lit(True).alias("crowded")))
    texts = work.cut(text.join(ids.groupBy("id").agg(F.max("crowded").alias("crowded")), "id").dropDuplicates(["id"]))
    work.drop(rows)

    def verify(p: DataFrame) -> DataFrame:
        p = work.cut(p.select("a", "b"))  # its size is then known before the plan is made: few pairs are broadcast, and the texts stay where they are
        p = p.join(texts.select(F.col("id").alias("b"), F.col("x").alias("y")), "b").join(texts.select(F.col("id").alias("a"), "x"), "a")
        return work.cut(p.select("a", "b", _similar(threshold)("x", "y").alias("ok")))

    best = pairs.groupBy("b").agg(F.max_by("a", F.struct("c", -F.col("a"))).alias("a")).select("a", "b")
    tested = verify(best)
    label = components(work, tested.where("ok"))
    for last in (False, True):
        cross = _cross(pairs.join(tested, ["a", "b"], "left_anti"), label)
        if not last:
            pick = F.struct("c", -F.col("a"), -F.col("b"))
            cross = cross.groupBy("gb").agg(F.max_by(F.struct("a", "b"), pick).alias("p")).select("p.a", "p.b")
        tested, label = _merge(work, tested, verify(cross), label)
    crowd = texts.where("crowded")
    if not crowd.isEmpty():
        new = _crowded(work, crowd, label, threshold)
        tested, label = _merge(work, tested, verify(new.join(tested, ["a", "b"], "left_anti")), label)
    links = label.select(F.col("g").alias("a"), F.col("id").alias("b")).unionByName(same.select(F.col("g").alias("a"), F.col("id").alias("b")))
    out = components(work, links)
    work.drop(label, same, tested, pairs, texts, node)
    return out.unionByName(out.select(F.col("g").alias("id"), "g")).distinct()


def _buckets(rows: DataFrame) -> DataFrame:
    """Rows (d) of the buckets with two members or more, with the size c, the smallest member s and up to SMALL - 1 members before this one, p."""
    by = W.partitionBy("key")
    order = by.orderBy("d")
    return rows.select("d", F.count("*").over(by).alias("c"), F.min("d").over(by).alias("s"), F.array(*[F.lag("d", j).over(order) for j in range(1, SMALL)]).alias("p")).where("c > 1")


def _counted(q: int):
    """(k, c): a partition's q-mers by the hash of each, in COUNTERS counters."""

    def counted(batches):
        release()
        total = np.zeros(COUNTERS, np.int64)
        for b in batches:
            data, off = utf8(b.column(0))
            for lo, hi in slices(off):
                _, _, h, first = words(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                v, _ = kmers(h, first, q)
                total += np.bincount((v & U64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k])], ["k", "c"])

    return counted


def _common(n: np.ndarray, threshold: float, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Of two texts within the threshold, the shorter of which has n words or more: the q-mers they have in common at least, and in how many of their rarest they are made to meet. Neither falls as n grows."""
    shared = np.ceil(n * (1 - q * (1 - threshold)) - (q - 1) - 1e-9).astype(np.int64)
    return shared, 1 + np.maximum(shared - 1, 0) // MEET


RARE = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("hist", T.BinaryType()), T.StructField("ws", T.ArrayType(T.LongType()))])


def _rarest(counts: np.ndarray, threshold: float, q: int):
    """Of each text: number of words, histogram (one byte a bucket, 255 for more), and the rarest q-mers, of which two texts within the threshold share as many as _common() has for the shorter one."""

    def rarest(text: pa.Array) -> pa.Array:
        release()
        data, off = utf8(text)
        n_all, hists, ws, lens = [np.zeros(0, np.int64)], [], [np.zeros(0, U64)], [np.zeros(1, np.int64)]
        for lo, hi in slices(off):
            _, _, h, first = words(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            n = np.diff(first)
            doc = np.repeat(np.arange(hi - lo), n)
            hist = np.bincount(doc * HISTOGRAM + (h >> U64(40)).astype(np.int64) % HISTOGRAM, minlength=(hi - lo) * HISTOGRAM)
            hists += np.minimum(hist, 255).astype(np.uint8).reshape(hi - lo, HISTOGRAM).tolist()
            v, start = kmers(h, first, q)
            own = np.diff(start)
            # of the q-mers in common, all but the first ``meet`` may stand behind the ones taken
            shared, meet = _common(n, threshold, q)
            need = np.where(n > 0, np.minimum(own, own - shared + meet), 0)
            doc = np.repeat(np.arange(hi - lo), own)
            order = np.lexsort((v, counts[(v & U64(COUNTERS - 1)).astype(np.int64)], doc))
            rank = np.arange(len(v)) - start[doc]
            ws.append(v[order][rank < need[doc]])
            lens.append(need)
            n_all.append(n)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(lens).cumsum().astype(np.int32)), pa.array(np.concatenate(ws).view(np.int64)))
        return pa.StructArray.from_arrays([pa.array(np.concatenate(n_all).astype(np.int32)), pa.array([bytes(x) for x in hists], pa.binary()), lists], ["n", "hist", "ws"])

    return arrow_udf(rarest, RARE)


def _across(threshold: float, q_mer: int):
    """Of two blocks of texts (id, g, n, hist): the pairs of different groups that may be within the threshold, and in how many q-mers they have to meet. Edit distance k changes a histogram by 2 k at most, so none that is within is left out."""

    def across(x: pa.Array, y: pa.Array) -> pa.Array:
        release()

        def side(a: pa.Array):
            v = a.flatten()
            i, g, n = (v.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            raw = b"".join(v.field(3).to_pylist())
            return a.offsets.to_numpy() - a.offsets[0].as_py(), i, g, n.astype(np.int64), np.frombuffer(raw, np.uint8).reshape(-1, HISTOGRAM).astype(np.int16)

        (ox, ix, gx, nx, hx), (oy, iy, gy, ny, hy) = side(x), side(y)
        out, lens = [np.zeros((0, 3), np.int64)], [0]
        for r in range(len(x)):
            a, b = slice(ox[r], ox[r + 1]), slice(oy[r], oy[r + 1])
            longer = np.maximum(nx[a][:, None], ny[b][None, :])
            limit = ((1 - threshold) * longer + 1e-9).astype(np.int64)
            ok = (gx[a][:, None] != gy[b][None, :]) & (np.abs(nx[a][:, None] - ny[b][None, :]) <= limit)
            p, q = np.nonzero(ok)
            for s in range(0, len(p), 1 << 14):  # some pairs at a time, as a histogram has many buckets
                at = slice(s, s + (1 << 14))
                near = np.abs(hx[a][p[at]] - hy[b][q[at]]).sum(axis=1, dtype=np.int64) <= 2 * limit[p[at], q[at]]
                ok[p[at], q[at]] = near
            p, q = np.nonzero(ok)
            _, meet = _common(np.minimum(nx[a][p], ny[b][q]), threshold, q_mer)
            ids = np.stack([np.minimum(ix[a][p], iy[b][q]), np.maximum(ix[a][p], iy[b][q]), meet], axis=1)
            out.append(np.unique(ids, axis=0))
            lens.append(len(out[-1]))
        flat = np.concatenate(out)
        pairs = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1]), pa.array(flat[:, 2])], ["a", "b", "meet"])
        return pa.ListArray.from_arrays(pa.array(np.cumsum(lens).astype(np.int32)), pairs)

    return arrow_udf(across, T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("meet", T.LongType())])))


def _crowded(work: Work, crowd: DataFrame, label: DataFrame, threshold: float) -> DataFrame:
    """(a, b): pairs of texts (id, x) of crowded buckets that are in different groups and may be within the threshold."""
    q = 2 if threshold >= 0.7 else 1  # below, two near texts of a few words may have no two in a row in common
    counts = np.zeros(COUNTERS, np.int64)
    seen = crowd.select("x").mapInArrow(_counted(q), "k long, c long").groupBy("k").agg(F.sum("c").alias("c")).toArrow()  # at most COUNTERS rows
    counts[seen["k"].to_numpy()] = seen["c"].to_numpy()
    own = work.cut(crowd.select("id", _rarest(counts, threshold, q)("x").alias("r")).select("id", "r.*"))
    own = own.join(label, "id", "left").withColumn("g", F.coalesce("g", "id"))
    rows = own.select("id", "g", F.explode("ws").alias("w"))
    each = rows.groupBy("w", "g").agg(F.count("*").alias("own"))
    lists = each.groupBy("w").agg(F.sum("own").alias("c"), F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo < hi").select("w", "c")
    # a group that fills blocks has its own ones, which needn't meet each other; the rest is spread over mixed ones
    rows = rows.join(lists, "w").join(each.where(F.col("own") >= BLOCK), ["w", "g"], "left")
    spread = F.pmod(F.xxhash64("id"), F.ceil(F.coalesce("own", "c") / BLOCK))
    rows = rows.select("w", "id", F.when(F.col("own").isNotNull(), F.col("g")).alias("pure"), spread.alias("k"), (F.col("c") > BLOCK).alias("many"))
    rows = rows.join(own.select("id", "g", "n", "hist"), "id")
    blocks = work.cut(rows.groupBy("w", "pure", "k", "many").agg(F.collect_list(F.struct("id", "g", "n", "hist")).alias("m")))
    x = blocks.where("pure is null").select(F.col("m").alias("x"), F.col("m").alias("y"))
    side = lambda v, i: blocks.where("many").select("w", F.struct(F.col("pure").isNull().alias("mixed"), "pure", "k").alias(f"b{i}"), F.col("m").alias(v))
    apart = (F.col("b1") < F.col("b2")) & ~F.coalesce(F.col("b1.pure") == F.col("b2.pure"), F.lit(False))
    x = x.unionByName(side("x", 1).join(side("y", 2), "w").where(apart).select("x", "y"))
    found = x.select(F.explode(_across(threshold, q)("x", "y")).alias("p")).select("p.*").where("a < b")
    # a pair comes once for each q-mer in which its texts meet
    met = found.groupBy("a", "b").agg(F.count("*").alias("c"), F.first("meet").alias("meet"))
    return work.cut(met.where("c >= meet").select("a", "b"))


def _cross(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """Pairs that join two groups."""
    x = pairs.join(label.select(F.col("id").alias("a"), F.col("g").alias("ga")), "a", "left").join(label.select(F.col("id").alias("b"), F.col("g").alias("gb")), "b", "left")
    return x.withColumn("ga", F.coalesce("ga", "a")).withColumn("gb", F.coalesce("gb", "b")).where("ga <> gb")


def _merge(work: Work, tested: DataFrame, new: DataFrame, label: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All tested pairs, and the groups with those that the new pairs join."""
    both = work.cut(tested.unionByName(new))
    out = components(work, label.select(F.col("g").alias("a"), F.col("id").alias("b")).unionByName(new.where("ok").select("a", "b")))
    work.drop(tested, new, label)
    return both, out


def near_dedup(docs: DataFrame, threshold: float = 0.8, m: int = 20, k: int = 3) -> DataFrame:
    """doc_id, group_id (the smallest doc_id of its group), kept: a row for each document that has a near copy."""
    return groups(docs, threshold, m, k).select(F.col("id").alias("doc_id"), F.col("g").alias("group_id"), (F.col("id") == F.col("g")).alias("kept"))


def keep_first(docs: DataFrame, threshold: float = 0.8, m: int = 20, k: int = 3) -> DataFrame:
    """docs without the near copies: of each group the smallest doc_id stays, with all its columns."""
    gone = groups(docs, threshold, m, k).where("id <> g").select(F.col("id").alias("__near_id"))
    return docs.join(gone, docs["doc_id"] == gone["__near_id"], "left_anti")
