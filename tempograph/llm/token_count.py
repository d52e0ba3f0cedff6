"""Exact token counts by a finite-state tokenizer.

The byte-pair vocabulary is compiled into a deterministic transducer over bytes whose transitions are annotated with the
change of the emitted-token count. It rests on two facts on byte-pair encoding: the encoding of a prefix is that of a
shorter prefix plus one token, and two tokens may be neighbours exactly if the pair encodes to itself. A state is the
longest suffix that begins a vocabulary token, with, for each such suffix, the last token before it and its count
relative to the whole: all that later bytes can depend on. States and transitions are compiled when first met, and a
worker keeps them; past ``MAX_STATES`` they are dropped between two batches and compiled anew. Another operator's function in
the same worker frees them (common.release).

The splitter (pretoken.py) is a transducer of its own; its chunk maps are composed by a parallel prefix scan. A piece's
start resets the byte transducer, so a chunk that begins there has a constant state map: chunks of all texts run side by
side, one byte a step, and their counts add up.

Defined results: a null text has a null count, an empty one 0. Special tokens' strings are ordinary text. Repeated rows are
counted each; null doc_ids are kept. Extra columns are not in the result.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.functions import arrow_udf

from .common import held, slices, utf8
from .pretoken import cuts, load_ranks

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MAX_STATES = 400_000
MAX_PAIRS = 1 << 19
LANE = 128
#: Bytes of text in one step; bounds a worker's memory.
STEP = 1 << 20
#: What a state's signature and a transition's change of the count can hold.
MAX_TOKEN, MAX_CHANGE = 255, 15
_LIVE = struct.Struct("<Bib")
PACK, UNPACK = _LIVE.pack, _LIVE.iter_unpack


class Transducer:
    def __init__(self, path: str):
        self.ranks = load_ranks(path)
        self.by_rank = {r: t for t, r in self.ranks.items()}
        self.prefixes = {t[:i] for t in self.ranks for i in range(1, len(t))}
        if max(map(len, self.ranks), default=0) > MAX_TOKEN or max(self.by_rank, default=0) >= 1 << 31:
            raise ValueError(f"tokens of at most {MAX_TOKEN} bytes and ranks under 2^31 are supported")
        if missing := [b for b in range(256) if bytes([b]) not in self.ranks]:
            raise ValueError(f"bytes without a token: {missing[:5]}")
        self.pairs: dict[int, bool] = {}
        self.single: dict[int, bool] = {}
        self.reset()

    def reset(self) -> None:
        self.key: dict = {}
        self.states: list = []
        self.bits = 18
        self.slot_key = np.full(1 << self.bits, -1, np.int64)  # state * 256 + byte; open addressing
        self.slot = np.zeros(1 << self.bits, np.int32)  # next state and change of the count, packed
        self.used = 0
        self.state(b"", [(0, -1, 0)])

    def state(self, suffix: bytes, live: list[tuple[int, int, int]]) -> int:
        sig = b"".join([bytes([len(suffix)]), suffix, *(PACK(*x) for x in live)])
        i = self.key.setdefault(sig, len(self.states))
        if i == len(self.states):
            self.states.append(sig)
        return i

    def put(self, key: int, value: int) -> None:
        if self.used * 2 > len(self.slot):
            old, val = self.slot_key, self.slot
            keep = np.flatnonzero(old >= 0)
            self.bits += 1
            self.slot_key, self.slot = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
            k, v = old[keep], val[keep]
            pos = self.hash(k)
            while len(k):
                _, one = np.unique(pos, return_index=True)
                one = one[self.slot_key[pos[one]] < 0]
                self.slot_key[pos[one]], self.slot[pos[one]] = k[one], v[one]
                rest = np.ones(len(k), bool)
                rest[one] = False
                k, v, pos = k[rest], v[rest], (pos[rest] + 1) & (len(self.slot) - 1)
        pos = (key * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> 64 - self.bits
        while self.slot_key[pos] >= 0:
            pos = (pos + 1) & (len(self.slot) - 1)
        self.slot_key[pos], self.slot[pos] = key, value
        self.used += 1

    def hash(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, key: np.ndarray) -> np.ndarray:
        """Packed transitions, compiled where they are new."""
        pos = self.hash(key)
        k = self.slot_key[pos]
        out = self.slot[pos]
        bad = np.flatnonzero(k != key)
        while len(bad):
            empty = k[bad] < 0
            if empty.any():
                for q in np.unique(key[bad[empty]]):
                    self.compile(int(q))
                pos = self.hash(key)  # the table may have grown
                k, out = self.slot_key[pos], self.slot[pos]
                bad = np.flatnonzero(k != key)
                continue
            pos[bad] = (pos[bad] + 1) & (len(self.slot) - 1)
            k[bad], out[bad] = self.slot_key[pos[bad]], self.slot[pos[bad]]
            bad = bad[k[bad] != key[bad]]
        return out

    def merge(self, piece: bytes) -> list[int]:
        """Byte-pair encoding by its definition."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[x] for x in parts]

    def may_follow(self, a: int, b: int) -> bool:
        if a < 0:
            ok = self.single.get(b)
            if ok is None:
                ok = self.single[b] = self.merge(self.by_rank[b]) == [b]
            return ok
        key = a << 31 | b
        ok = self.pairs.get(key)
        if ok is None:
            if len(self.pairs) > MAX_PAIRS:
                self.pairs.clear()
            ok = self.pairs[key] = self.merge(self.by_rank[a] + self.by_rank[b]) == [a, b]
        return ok

    def compile(self, key: int) -> None:
        sig = self.states[key >> 8]
        n = sig[0]
        suffix = sig[1 : n + 1] + bytes([key & 255])
        n += 1
        last = count = None
        keep = []
        for d, before, rel in UNPACK(sig[n:]):
            end = suffix[n - d - 1 :]
            if last is None:
                r = self.ranks.get(end)
                if r is not None and self.may_follow(before, r):
                    last, count = r, rel + 1
            if end in self.prefixes:
                keep.append((d + 1, before, rel))
        live = [(d, before, rel - count) for d, before, rel in keep]
        suffix = suffix[n - max((d for d, _, _ in keep), default=0) :]
        if not -MAX_CHANGE <= count <= MAX_CHANGE:
            raise ValueError("a byte changes the count by more than a transition can hold")
        self.put(key, self.state(suffix, [*live, (0, last, 0)]) * 32 + count + 16)

    def counts(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Number of tokens of each text."""
        n = len(off) - 1
        if not len(data):
            return np.zeros(n, np.int64)
        if len(self.states) > MAX_STATES:
            self.reset()
        cut = cuts(data, off)
        text = np.searchsorted(off, cut, "right") - 1
        # chunks: from the first cut in each LANE bytes, and from each text's start
        new = np.ones(len(cut), bool)
        new[1:] = (cut[1:] // LANE != cut[:-1] // LANE) | (text[1:] != text[:-1])
        start, owner = cut[new], text[new]
        length = np.diff(np.append(start, len(data)))
        order = np.argsort(-length, kind="stable")
        start, owner, length = start[order], owner[order], length[order]
        sym = data
        keep = np.full(len(data), -1, np.int8)
        keep[cut] = 0  # a piece starts anew
        state, total, at = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64), start
        for j in range(int(length[0])):
            if length[len(state) - 1] <= j:
                active = int(np.searchsorted(-length, -j, "left"))
                state, at = state[:active], at[:active]
            x = self.get((state & keep[at]) << 8 | sym[at]).astype(np.int64)
            total[: len(x)] += (x & 31) - 16
            state = x >> 5
            at = at + 1
        return np.bincount(owner, weights=total, minlength=n).astype(np.int64)


def transducer(path: str) -> Transducer:
    return held(("transducer", path), lambda: Transducer(path))


def counter(path: str = VOCABULARY):
    """An Arrow UDF from text to its number of tokens."""

    def count(text: pa.Array) -> pa.Array:
        t = transducer(path)
        data, off = utf8(text)
        out = np.zeros(len(off) - 1, np.int64)
        for lo, hi in slices(off, STEP):
            out[lo:hi] = t.counts(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        return pa.array(out, mask=text.is_null().to_numpy(zero_copy_only=False))

    return arrow_udf(count, T.LongType())


def token_count(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens: a row for each row of docs."""
    return docs.select("doc_id", counter(path)(F.col("text")).alias("n_tokens"))
