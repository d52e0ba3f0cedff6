import random

import numpy as np
import pyarrow as pa
import pytest

from tempograph.llm import bpe, packing, pretoken, token_count
from tempograph.llm.common import utf8

from .helpers import LONG, awkward, empty, frame

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def enc():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=pretoken.load_ranks(token_count.VOCABULARY), special_tokens={})


def texts():
    rng = random.Random(7)
    al = ["a", "l", "v", "e", "r", "s", "t", " ", "  ", "\n", "\t", "'", "'s", "'ll", "'ve", "1", "23", "é", "ß", "你", "🙂", "!", "?", " the", " of", " ", " "]
    return ["".join(rng.choice(al) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + ["", "'l", "x'v", "'r", "a" * 2000, " " * 700, "<|endoftext|>", LONG]


def test_counts_and_ids_are_those_of_the_library(enc):
    t = texts()
    want = [enc.encode_ordinary(x) for x in t]
    data, off = utf8(pa.array(t))
    assert token_count.transducer(token_count.VOCABULARY).counts(data, off).tolist() == [len(x) for x in want]
    c = bpe.codec(token_count.VOCABULARY)
    ids, o = c.encode(data, off)
    assert [ids[a:b].tolist() for a, b in zip(o[:-1], o[1:])] == want
    back, at = c.decode(ids, o)
    assert np.array_equal(back, data) and np.array_equal(at, off)


def test_a_flushed_transducer_counts_the_same(enc, monkeypatch):
    monkeypatch.setattr(token_count, "MAX_STATES", 10)
    t = token_count.Transducer(token_count.VOCABULARY)
    for x in ["one two three", "onan erthe 'll ention", ""]:
        data, off = utf8(pa.array([x]))
        assert t.counts(data, off).tolist() == [len(enc.encode_ordinary(x))]


def test_state_maps_compose_like_functions():
    rng = np.random.default_rng(0)
    maps = rng.integers(0, 13, (37, 13)).astype(np.uint16)
    got, acc = pretoken.compose(maps), np.arange(13)
    for i, m in enumerate(maps):
        acc = m[acc]
        assert np.array_equal(got[i], acc)


def test_awkward_rows(spark, enc):
    d = frame(spark)
    got = sorted(((r.doc_id, r.n_tokens) for r in token_count.token_count(d).collect()), key=str)
    assert got == sorted(((r[0], None if r[1] is None else len(enc.encode_ordinary(r[1]))) for r in awkward()), key=str)
    ids = bpe.encode(d)
    assert sorted((str(r.doc_id), str(r.text)) for r in bpe.decode(ids).collect()) == sorted((str(r[0]), str(r[1])) for r in awkward())
    assert all((r.ids is None) == (r.text is None) for r in d.select("text", bpe.encoder()("text").alias("ids")).collect())
    assert token_count.token_count(empty(spark)).count() == 0 and bpe.encode(empty(spark)).count() == 0


def greedy(n, cost, capacity):
    k = max(1, -(-sum(n) // capacity))
    seqs = [[0, 0.0] for _ in range(k)]
    out = []
    for x, c in zip(n, cost):
        fit = [(s[1], i) for i, s in enumerate(seqs) if s[0] + x <= capacity]
        i = min(fit)[1] if fit else len(seqs)
        if not fit:
            seqs.append([0, 0.0])
        seqs[i][0] += x
        seqs[i][1] += c
        out.append(i)
    return out


def test_packing_is_the_greedy_assignment():
    rng = np.random.default_rng(1)
    n = np.sort(rng.integers(1, 100, 400))[::-1]
    cost = n + n.astype(float) ** 2 / 50
    assert packing.assign(n, cost, 128).tolist() == greedy(n.tolist(), cost.tolist(), 128)


def test_packing_covers_every_token_once(spark, enc):
    d = frame(spark)
    rows = packing.pack(d, capacity=64, shard_tokens=1 << 30).collect()
    want = sum(len(enc.encode_ordinary(r[1])) for r in awkward() if r[1])
    assert sum(r.n_tokens for r in rows) == want
    load = {}
    for r in rows:
        load[r.sequence_id] = load.get(r.sequence_id, 0) + r.n_tokens
    assert max(load.values()) <= 64
    order = sorted(rows, key=lambda r: (-r.n_tokens, r.doc_id is None, r.doc_id or 0, r.start_token))
    want = greedy([r.n_tokens for r in order], [r.cost for r in order], 64)
    # equal pieces may change places
    assert sorted((r.n_tokens, w) for r, w in zip(order, want)) == sorted((r.n_tokens, r.sequence_id % (1 << 32)) for r in order)
    assert packing.pack(empty(spark)).count() == 0
