"""The pipeline over a small corpus with planted cases, each stage against its own rule done directly."""

import random

import corpus_pipeline
from tempograph.llm import secret_scan, token_count
from tempograph.llm.common import utf8

from .helpers import SCHEMA, awkward

WORDS = [f"{a}{b}{c}" for a in ("ba", "ke", "mo", "ru", "ti") for b in ("lan", "dor", "fex", "vin") for c in ("a", "os", "it", "ue", "en", "y")]


def prose(rng, n):
    out = []
    for i in range(n):
        out.append(rng.choice(WORDS) + rng.choice([""] * 7 + [",", "."]))
    return " ".join(out)


def corpus():
    """(texts by doc_id, labels, what is planted)."""
    rng = random.Random(11)
    texts = {i: prose(rng, rng.randint(90, 160)) for i in range(1, 161)}
    labels = [(i, 1, 0) for i in range(1, 61)]
    toxic = set(range(200, 240))
    for i in toxic:
        w = prose(rng, 110).split()
        for j in rng.sample(range(110), 8):
            w[j] = rng.choice(["slurone", "slurtwo", "slurthree"])
        texts[i] = " ".join(w)
    labels += [(i, 0, 1) for i in range(200, 230)]
    copies = {300: 3, 301: 4, 302: 4}
    for i, of in copies.items():
        w = texts[of].split()
        for j in rng.sample(range(len(w)), 3):
            w[j] = "changed"
        texts[i] = " ".join(w)
    passage = prose(rng, 70)
    for i in (20, 21, 22):
        texts[i] = f"{prose(rng, 90)} {passage} {prose(rng, 80)}"
    key = "".join(rng.choice("0123456789abcdef") for _ in range(48))
    keys = {30 + j: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40)) for j in range(12)} | {50: key}
    for i, k in keys.items():
        texts[i] += f" token={k} {prose(rng, 5)}"
    return texts, labels, toxic, copies, passage, keys


def test_every_stage(spark, tmp_path):
    texts, labels, toxic, copies, passage, keys = corpus()
    at = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", len(t), 0.5, "i", "d", "g", "w") for i, t in texts.items()], SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    docs, seen = spark.read.parquet(f"{at}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, at)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.dtypes == docs.dtypes
        out.write.parquet(f"{at}/{name.replace(' ', '-')}")
        docs = spark.read.parquet(f"{at}/{name.replace(' ', '-')}")
        seen.append((name, docs))
    got = [{r.doc_id: r.text for r in d.collect()} for _, d in seen[:4]]
    # toxicity: who says the words goes, and nobody else; texts stay as they are
    assert got[0] == {i: t for i, t in texts.items() if i not in toxic}
    # near copies: of each planted group the smallest stays
    assert got[1] == {i: t for i, t in got[0].items() if i not in copies}
    # repeats: the passage stays once, in the first document that has it
    assert set(got[2]) == set(got[1]) and {i for i in got[2] if got[2][i] != got[1][i]} == {21, 22}
    middle = " ".join(passage.split()[12:58])
    assert middle in got[2][20] and middle not in got[2][21] and middle not in got[2][22]
    # secrets: the keys are replaced and the rest stays
    for i, t in got[2].items():
        assert got[3][i] == (t.replace(keys[i], "[SECRET]") if i in keys else t)
    # packing: every token of every text once, no sequence over its capacity
    count = {}
    for i, t in got[3].items():
        count[i] = int(token_count.transducer(token_count.VOCABULARY).counts(*utf8(__import__("pyarrow").array([t])))[0])
    packed = seen[4][1].collect()
    per, load = {}, {}
    for r in packed:
        per[r.doc_id] = per.get(r.doc_id, 0) + r.n_tokens
        load[r.sequence_id] = load.get(r.sequence_id, 0) + r.n_tokens
    assert per == count and max(load.values()) <= 8192
    key = lambda r: (r.sequence_id, r.position, r.doc_id, r.start_token, r.n_tokens)
    assert sorted(map(key, corpus_pipeline.run(spark, at).collect())) == sorted(map(key, packed))


def test_awkward_tables(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows and clashing columns; no labels; and an empty table."""
    for name, rows in (("a", awkward()), ("b", [])):
        at = f"{tmp_path}/{name}"
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
        got = corpus_pipeline.run(spark, at).collect()
        assert (len(got) > 0) == bool(rows) and all(r.n_tokens > 0 for r in got)


def test_statistics_by_their_definitions():
    """The three statistics of a random string, done again from their definitions, give the p-value."""
    import math

    import numpy as np

    letters = np.array([8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.095, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.074])
    letters = letters / letters.sum()
    rng = random.Random(3)
    for alphabet, name in (("0123456789abcdef", "hex"), ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "base62")):
        s = "".join(rng.choice(alphabet) for _ in range(40))
        enc, p = secret_scan.p_values([s], letters)
        assert enc == [name]
        k, n = len(alphabet), len(s)
        q = letters[:6] / letters[:6].sum() if name == "hex" else letters
        probs = [x * 0.9 for x in q] + [0.01] * 10
        # uniformity: chi-squared against k equal cells, with mean and variance under the ordinary text's cells
        chi = sum((s.count(c) - n / k) ** 2 / (n / k) for c in alphabet)
        s2, s3 = sum(x**2 for x in probs), sum(x**3 for x in probs)
        mean = k * ((n - 1) * s2 + 1) - n
        var = k * k * (n - 1) / n * (4 * (n - 2) * s3 + 2 * s2 - (4 * n - 6) * s2**2)
        z1 = (chi - mean) / math.sqrt(var)
        kind = ["d" if c.isdigit() else "l" if c.islower() else "u" for c in s]
        changes = sum(a != b for a, b in zip(kind, kind[1:]))
        z2 = -(changes - (n - 1) / 12) / math.sqrt((n - 1) / 12 * 11 / 12)
        top = "u" if "u" in kind else "l"
        x = [float(c == top) for c in kind]
        m = sum(x) / n
        rho = sum((a - m) * (b - m) for a, b in zip(x[1:], x)) / sum((a - m) ** 2 for a in x)
        z3 = (rho - 10 / 12) * math.sqrt(n) / math.sqrt(1 - (10 / 12) ** 2)
        want = 0.5 * math.erfc(-(z1 + z2 + z3) / 3 / math.sqrt(2))
        assert abs(math.log(max(want, 1e-15)) - math.log(p[0])) < 1e-6
        plain = "the-quick-brown-fox-Jumps-over2"
        assert secret_scan.p_values([plain], letters)[1][0] > 100 * p[0]
