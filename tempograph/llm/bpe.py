"""Byte-pair encoding by forced-boundary splitting, and decoding.

Two neighbouring bytes that never occur next to each other inside a vocabulary token are a certain cut: no token can span
them. So is the start of a piece under the vocabulary's pattern. Between cuts the fragments are encoded independently
and the results concatenated, which is exact. Each distinct fragment of a batch is encoded once, all of them side by side:
each round merges in every fragment its leftmost pair of lowest rank.

Defined results: null text has null ids, an empty one no ids. Special tokens' strings are ordinary text. Decoding ids
gives the text back; a null id list decodes to null. Repeated rows are encoded each. Extra columns are not in the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.functions import arrow_udf

from .common import held, slices, span_hash, utf8
from .pretoken import cuts, load_ranks
from .token_count import VOCABULARY


class Codec:
    def __init__(self, path: str):
        ranks = load_ranks(path)
        size = max(ranks.values()) + 1
        self.size = size
        tokens = [b""] * size
        for t, r in ranks.items():
            tokens[r] = t
        self.tokens = tokens
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.inside = np.zeros((256, 256), bool)
        for t in ranks:
            x = np.frombuffer(t, np.uint8)
            self.inside[x[:-1], x[1:]] = True
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)])
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)
        # every way to make a token of two others
        pairs: dict[int, int] = {}
        for t, r in ranks.items():
            for i in range(1, len(t)):
                a, b = ranks.get(t[:i]), ranks.get(t[i:])
                if a is not None and b is not None:
                    pairs[a * size + b] = r
        key = np.array(sorted(pairs), np.int64)
        self.bits = 19
        self.slot_key = np.full(1 << self.bits, -1, np.int64)
        self.slot_rank = np.full(1 << self.bits, 1 << 40, np.int64)
        rank = np.array([pairs[k] for k in key.tolist()], np.int64)
        pos = self.hash(key)
        self.probes = 0
        while len(key):
            self.probes += 1
            _, one = np.unique(pos, return_index=True)
            one = one[self.slot_key[pos[one]] < 0]
            self.slot_key[pos[one]], self.slot_rank[pos[one]] = key[one], rank[one]
            rest = np.ones(len(key), bool)
            rest[one] = False
            key, rank, pos = key[rest], rank[rest], (pos[rest] + 1) & ((1 << self.bits) - 1)

    def hash(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair makes; 1 << 40 for none, and where either is negative."""
        key = a * self.size + b
        out = np.full(key.shape, 1 << 40, np.int64)
        todo = np.flatnonzero((a >= 0).ravel() & (b >= 0).ravel())
        key, flat = key.ravel(), out.ravel()
        pos = self.hash(key[todo])
        while len(todo):
            k = self.slot_key[pos]
            hit = k == key[todo]
            flat[todo[hit]] = self.slot_rank[pos[hit]]
            go = ~hit & (k >= 0)
            todo, pos = todo[go], (pos[go] + 1) & ((1 << self.bits) - 1)
        return out

    def fragments(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the fragments one after the other, and the count of each."""
        order = np.argsort(length, kind="stable")
        count = np.zeros(len(start), np.int64)
        where, pieces = [], []
        at = 0
        while at < len(order):
            lo = int(length[order[at]])
            hi = max(lo, min(lo + lo // 2, 1 << 30))
            end = int(np.searchsorted(length[order], hi, "right"))
            end = min(end, at + max(1, (1 << 20) // max(hi, 1)))
            part = order[at:end]
            at = end
            n = length[part]
            w = int(n.max())
            idx = np.arange(w)
            t = np.where(idx < n[:, None], self.byte[data[np.minimum(start[part][:, None] + idx, len(data) - 1)]], -1)
            rows, live = np.arange(len(part)), t
            r = self.rank(live[:, :-1], live[:, 1:]) if w > 1 else np.zeros((len(part), 0), np.int64)
            while w > 1 and len(rows):
                j = r.argmin(axis=1)
                best = r[np.arange(len(rows)), j]
                go = best < 1 << 40
                if not go.all():
                    t[rows[~go], : live.shape[1]] = live[~go]
                    t[rows[~go], live.shape[1] :] = -1
                    rows, live, r, j, best = rows[go], live[go], r[go], j[go], best[go]
                    if not len(rows):
                        break
                # drop the right one of the pair: everything behind it moves by one
                width = live.shape[1]
                k = np.arange(width - 1)
                live = np.take_along_axis(live, k + (k > j[:, None]), axis=1)
                me = np.arange(len(rows))
                live[me, j] = best
                if width == 2:
                    t[rows, :1], t[rows, 1:] = live, -1
                    break
                k = np.arange(width - 2)
                r = np.take_along_axis(r, k + (k >= j[:, None]), axis=1)
                left = np.maximum(j - 1, 0)
                r[me, left] = np.where(j > 0, self.rank(live[me, left], live[me, left + 1]), r[me, left])
                right = np.minimum(j, width - 3)
                r[me, right] = np.where(j < width - 2, self.rank(live[me, right], live[me, right + 1]), r[me, right])
            got = t >= 0
            count[part] = got.sum(axis=1)
            where.append(part)
            pieces.append(t[got])
        where = np.concatenate(where)
        flat = np.concatenate(pieces)
        # back to the order of the fragments
        first = np.empty(len(start), np.int64)
        first[where] = np.concatenate([[0], np.cumsum(count[where])[:-1]])
        return flat[ragged(first, count)], count

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and offsets of each text's."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
        cut = np.zeros(len(data), bool)
        cut[cuts(data, off)] = True
        cut[1:] |= ~self.inside[data[:-1], data[1:]]
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(data))
        length = end - start
        h = span_hash(data, start, end)
        _, rep, inv = np.unique(h, return_index=True, return_inverse=True)
        # equal hashes must be equal fragments; otherwise every fragment is encoded by itself
        own = rep[inv]
        same = (length == length[own]).all() and np.array_equal(data, data[ragged(start[own], length)])
        if not same:
            rep, inv = np.arange(len(start)), np.arange(len(start))
        ids, count = self.fragments(data, start[rep], length[rep])
        first = np.concatenate([[0], np.cumsum(count)])[:-1]
        out = ids[ragged(first[inv], count[inv])]
        total = np.concatenate([[0], np.cumsum(count[inv])])
        return out.astype(np.int32), total[np.searchsorted(start, off)]

    def decode(self, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.length[ids]
        total = np.concatenate([[0], np.cumsum(n)])
        return self.blob[ragged(self.start[ids], n)], total[off]


def ragged(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Indices first[0], first[0] + 1, ... (count[0] of them), first[1], ..."""
    total = int(count.sum())
    before = np.concatenate([[0], np.cumsum(count)[:-1]]) if len(count) else count
    return np.arange(total) - np.repeat(before - first, count)


def codec(path: str) -> Codec:
    return held(("codec", path), lambda: Codec(path))


#: Bytes of text in one step; bounds a worker's memory.
STEP = 1 << 20


def encode_column(text: pa.Array, c: Codec) -> tuple[pa.Array, np.ndarray]:
    """Lists of ids, and whether each decodes to its text's bytes."""
    data, off = utf8(text)
    ids, lens, same = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)], np.ones(len(off) - 1, bool)
    for lo, hi in slices(off, STEP):
        part, at = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        x, o = c.encode(part, at)
        back, to = c.decode(x, o)
        if not (np.array_equal(to, at) and np.array_equal(back, part)):
            same[lo:hi] = [np.array_equal(back[to[i] : to[i + 1]], part[at[i] : at[i + 1]]) for i in range(hi - lo)]
        ids.append(x)
        lens.append(o[1:] + lens[-1][-1])
    offsets = np.concatenate(lens).astype(np.int32)
    null = text.is_null().to_numpy(zero_copy_only=False)
    return pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(null, False)) if null.any() else pa.array(offsets), pa.array(np.concatenate(ids))), same


def encoder(path: str = VOCABULARY):
    """An Arrow UDF from text to token ids."""
    return arrow_udf(lambda text: encode_column(text, codec(path))[0], T.ArrayType(T.IntegerType()))


def checked_encoder(path: str = VOCABULARY):
    """An Arrow UDF from text to a struct of its token ids and whether they decode to it."""

    def encode(text: pa.Array) -> pa.Array:
        ids, same = encode_column(text, codec(path))
        return pa.StructArray.from_arrays([ids, pa.array(same)], ["ids", "round_trip"])

    return arrow_udf(encode, T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("round_trip", T.BooleanType())]))


def decoder(path: str = VOCABULARY):
    """An Arrow UDF from token ids to text; bytes that aren't UTF-8 become U+FFFD."""

    def decode(ids: pa.Array) -> pa.Array:
        c = codec(path)
        off = ids.offsets.to_numpy().astype(np.int64)
        data, at = c.decode(ids.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]].astype(np.int64), off - off[0])
        raw, null = data.tobytes(), ids.is_null().to_pylist()
        return pa.array([None if m else raw[a:b].decode("utf-8", "replace") for a, b, m in zip(at[:-1], at[1:], null, strict=True)], pa.string())

    return arrow_udf(decode, T.StringType())


def encode(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, ids: a row for each row of docs."""
    return docs.select("doc_id", encoder(path)(F.col("text")).alias("ids"))


def decode(tokens: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, text from doc_id, ids."""
    return tokens.select("doc_id", decoder(path)(F.col("ids")).alias("text"))
