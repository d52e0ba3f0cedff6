import numpy as np
import pytest

from tempograph.llm import chat, topk


@pytest.mark.parametrize("every, limit, level", [(1, 0, 2), (50, 32 << 20, 512)])
def test_topk_is_brute_force(spark, monkeypatch, every, limit, level):
    """Tiles joined on both sides and sums that meet in two steps; and queries that are broadcast."""
    monkeypatch.setattr(topk, "BROADCAST", limit)
    monkeypatch.setattr(topk, "LEVEL", level)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 16))
    x[7] = x[3]  # a tie
    df = spark.createDataFrame([(i, [float(v) for v in r], 0, 1.0) for i, r in enumerate(x.astype(np.float32))], "vec_id long, embedding array<float>, label int, similarity double")
    got = {}
    for r in topk.nearest(df, k=5, block=64, every=every).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.neighbour_id
    y = x.astype(np.float32).astype(float)
    y /= np.sqrt((y * y).sum(axis=1))[:, None]
    assert sorted(got) == list(range(0, 300, every))
    for i in got:
        s = np.array([np.dot(y[i], y[j]) for j in range(300)])
        want = sorted((j for j in range(300) if j != i), key=lambda j: (-round(s[j], 12), j))[:5]
        assert [got[i][k] for k in range(1, 6)] == want


def test_topk_awkward(spark):
    nan = float("nan")
    data = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (2, [1.0, 0.1]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (None, [1.0, 1.0]), (8, [1.0, 2.0, 3.0]), (9, [None, 1.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    assert sorted((r.query_id, r.rank, r.neighbour_id) for r in topk.nearest(df, every=1).collect()) == [(1, 1, 2), (2, 1, 1)]
    assert topk.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


CONV = "conv_id long, turn long, role string, text string, rendered string"


def conversations(spark, n=80):
    rng, rows = np.random.default_rng(4), []
    for c in range(n):
        roles = (["system"] if c % 5 == 0 else []) + ["user", "assistant"] * (1 + c % 3)
        for t, r in enumerate(roles):
            k = {"user": 20, "system": 30, "assistant": 120}[r]
            rows.append((c, t, r, " ".join(rng.choice(["onan", "erthe", "ention", "que"], k)), "x"))
    return spark.createDataFrame(rows, CONV)


def test_roles_held_out(spark):
    raw = chat.transcripts(conversations(spark))
    p = chat.fit(raw.where("conv_id % 2 = 0"))
    test = raw.where("conv_id % 2 = 1")
    got = {r.conv_id: r for r in chat.format_chats(test, p).collect()}
    truth = {r.conv_id: [x for x in r.roles if not x.endswith("+")] for r in test.collect()}
    right = sum(got[c].roles == t for c, t in truth.items())
    assert right >= 0.9 * len(truth)
    assert all(r.rendered.count("<|end|>") == r.n_turns for r in got.values())


def brute_viterbi(f, p):
    import itertools

    best = None
    for s in itertools.product(range(len(chat.STATES)), repeat=len(f)):
        v = p["start"][s[0]] + sum(p["step"][a, b] for a, b in zip(s, s[1:])) + sum(p[k][x, f[i, j]] for i, x in enumerate(s) for j, k in enumerate("mgl"))
        if best is None or v > best[0] + 1e-12:
            best = (v, list(s))
    return best[1]


def test_counts_are_those_of_the_lines(spark):
    """The model is the prior plus a count for each line and each step between lines, done here directly."""
    raw = chat.transcripts(conversations(spark, 12))
    want = chat.prior()
    index = {(r if k == "B" else f"{r}+"): i for i, (r, k) in enumerate(chat.STATES)}
    for r in raw.collect():
        _, f = chat.features(r.text)
        assert len(f) == len(r.roles)
        states = [index[x] for x in r.roles]
        want["start"][states[0]] += 1
        for a, b in zip(states, states[1:]):
            want["step"][a, b] += 1
        for s, x in zip(states, f):
            for k, v in zip("mgl", x):
                want[k][s, v] += 1
    got = chat.fit(raw)
    assert all(np.allclose(np.exp(got[k]), v / v.sum(axis=-1, keepdims=True)) for k, v in want.items())


def test_viterbi_is_the_likeliest_path():
    p = chat.logs(chat.prior())
    _, f = chat.features("User: hi\nmore\n\nAssistant: yes it is")
    assert chat.viterbi(f, p) == brute_viterbi(f, p)
    assert chat.parse("User: hi\nmore\n\nAssistant: yes it is", p) == [("user", "hi\nmore"), ("assistant", "yes it is")]


def test_chat_awkward(spark):
    data = [(1, 0, "user", "hi", "x"), (1, 0, "user", "hi", "x"), (1, 1, None, "what", "x"), (1, 2, "assistant", None, "x"), (2, 0, "user", "", "x"), (None, 0, "user", "lost", "x"), (None, 0, "user", "lost", "x"), (None, None, None, None, None), (3, 0, "wizard", "abra\n\ncadabra", "x"), (4, 0, "user", "long " * 50_000, "x")]
    raw = chat.transcripts(spark.createDataFrame(data, CONV))
    got = chat.format_chats(raw, chat.fit(raw)).collect()
    assert sorted(str(r.conv_id) for r in got) == ["1", "3", "4", "None", "None"]
    with pytest.raises(ValueError):
        chat.transcripts(spark.createDataFrame([("a", 0, "user", "x", "y")], CONV.replace("conv_id long", "conv_id string")))
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "\n \n")], "conv_id long, text string")
    assert [(r.n_turns, r.rendered) for r in chat.format_chats(odd, chat.logs(chat.prior())).collect()] == [(0, "")] * 3
    none = chat.transcripts(spark.createDataFrame([], CONV))
    assert chat.format_chats(none, chat.fit(none)).count() == 0
