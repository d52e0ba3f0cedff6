import math
import random

import numpy as np
import pyarrow as pa

from tempograph.llm import perplexity, secret_scan, toxicity
from tempograph.llm.common import Work

from .helpers import awkward, empty, frame, rows


def brute_segments(s):
    """Maximal-scoring segments by the recursive definition."""

    def best(lo, hi):
        top = None
        for a in range(lo, hi):
            t = 0
            for b in range(a, hi):
                t += s[b]
                if t > 1e-12 and (top is None or t > top[0] + 1e-12):
                    top = (t, a, b + 1)
        if top is None:
            return []
        return best(lo, top[1]) + [(top[1], top[2], top[0])] + best(top[2], hi)

    return best(0, len(s))


def test_segments_are_maximal():
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randint(1, 30)
        pos = sorted(rng.sample(range(n), rng.randint(0, min(n, 8))))
        sc = [rng.uniform(0.5, 4) for _ in pos]
        s = [-0.7] * n
        for p, x in zip(pos, sc):
            s[p] = x
        got = [(a, b, round(x, 9)) for a, b, x in toxicity.segments(pos, sc, n, -0.7)]
        assert got == [(a, b, round(x, 9)) for a, b, x in brute_segments(s)]


def test_calibration():
    assert toxicity.calibrate([1.0], 100) == 1.0
    assert toxicity.calibrate([20.0], 100) < 1e-5
    assert toxicity.calibrate([8.0, 8.0, 8.0], 100) < toxicity.calibrate([8.0], 100)


def words(rng, n):
    return [rng.choice([f"w{c}{d}" for c in "abcdefghij" for d in "klmnopqrst"]) for _ in range(n)]


def toxic_corpus(n=240):
    rng, texts, labels = random.Random(5), [], []
    for i in range(n):
        w, bad = words(rng, 120), i % 4 == 0
        if bad:
            for j in rng.sample(range(120), 6):
                w[j] = rng.choice(["slurone", "slurtwo", "slurthree"])
        texts.append(" ".join(w))
        labels.append((i + 1, 1, int(bad)))
    return texts, labels


def test_toxicity_held_out(spark):
    texts, labels = toxic_corpus()
    d = frame(spark, rows(texts))
    lab = spark.createDataFrame(labels[:160], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.toxic for r in toxicity.score(d, toxicity.fit(d, lab)).collect()}
    held = labels[160:]
    assert all(got[i] == bool(y) for i, _, y in held)


def test_log_odds_by_their_definition(spark):
    """Scores from counts of distinct contexts, the pooled prior and the bounds, done again directly."""
    texts, labels = toxic_corpus(160)
    m = toxicity.fit(frame(spark, rows(texts)), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    seen = {0: set(), 1: set()}
    for (_, _, y), t in zip(labels, texts):
        w = ["", *t.lower().split(), ""]
        seen[y] |= {(w[i - 1], w[i], w[i + 1]) for i in range(1, len(w) - 1)}
    count = {y: {} for y in seen}
    for y, s in seen.items():
        for _, w, _ in s:
            count[y][w] = count[y].get(w, 0) + 1
    n1, n0 = (sum(count[y].values()) for y in (1, 0))
    share, want = n1 / (n1 + n0), {}
    log = lambda k, e: k * math.log(k / e) if k else 0.0
    for w, c1 in count[1].items():
        c0 = count[0].get(w, 0)
        c = c1 + c0
        z = math.sqrt(max(0, 2 * (log(c1, c * share) + log(c0, c * (1 - share)))))
        a = 500 * c / (n1 + n0)
        p1, p0 = (c1 + a) / (n1 + 500), (c0 + a) / (n0 + 500)
        if c1 > 1 and c1 > c * share and z >= 4 and math.log(p1 / p0) >= 1:
            want[w] = (math.log(p1 / p0), p1, p0)
    assert set(want) == {"slurone", "slurtwo", "slurthree"}
    data, off = toxicity.utf8(pa.array(sorted(want)))
    h = toxicity.words(data, off)[2]
    other = math.log((1 - sum(x[1] for x in want.values())) / (1 - sum(x[2] for x in want.values())))
    for g in ("en", toxicity.POOLED):
        key, score, rest = m[g]
        got = {w: score[list(key).index(x)] for w, x in zip(sorted(want), h)}
        assert all(abs(got[w] - want[w][0]) < 1e-9 for w in want) and abs(rest - other) < 1e-9


def test_p_values_hold_under_the_clean_model():
    """Texts drawn from the clean model have a p-value under x in at most about x of all cases."""
    rng = random.Random(9)
    p1, p0 = 0.05, 0.002
    hit, other = math.log(p1 / p0), math.log((1 - p1) / (1 - p0))
    ps = []
    for _ in range(4000):
        pos = [i for i in range(200) if rng.random() < p0]
        ps.append(toxicity.calibrate([s for _, _, s in toxicity.segments(pos, [hit] * len(pos), 200, other)], 200) if pos else 1.0)
    for x in (0.2, 0.05, 0.01):
        assert sum(p <= x for p in ps) / len(ps) <= x * 1.3 + 0.002


def test_long_texts_have_all_their_contexts(spark):
    """A text beyond a step is taken whole."""
    long = " ".join(f"w{i}" for i in range(300_000))
    got = toxicity._contexts(pa.array([long, None, "one two one two"]))
    assert [len(x) for x in got.to_pylist()] == [300_000, 0, 4]


def test_toxicity_awkward(spark):
    texts, labels = toxic_corpus()
    lab = spark.createDataFrame([*labels, (None, 1, 1), (1, None, None), (1, 1, 1)], "doc_id long, quality int, toxic int")
    m = toxicity.fit(frame(spark, rows(texts)), lab)
    d = frame(spark)
    assert toxicity.score(d, m).count() == len(awkward()) and toxicity.score(d, m).where("toxic").count() == 0
    kept = toxicity.keep_clean(d, m)
    assert kept.columns == d.columns and kept.count() == len(awkward())
    assert toxicity.fit(empty(spark), lab) == {} and toxicity.score(d, {}).where("toxic").count() == 0
    assert toxicity.score(empty(spark), m).count() == 0
    bad = frame(spark, [(None, "slurone slurtwo slurone slurthree", None, None, None, None, None, None, None, None)] * 2)
    assert toxicity.score(bad, m).where("toxic").count() == 2 and toxicity.keep_clean(bad, m).count() == 0


def test_secrets(spark):
    rng = random.Random(1)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(20)]
    b64 = ["".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(32)) for _ in range(20)]
    plain = ["internationalisation2", "my_variable_name_2", "HelloWorldThisIsCamelCase", "documents-for-everyone-2024", "4785380592391141", "example-com/path/to/page1"]
    prose = "the ordinary words of this text come again and again in the same old order "
    texts = [f"{prose} key={s} {prose}" for s in hexes + b64] + [prose + p for p in plain * 3]
    d = frame(spark, rows(texts))
    m = secret_scan.model(d)
    got = {r.doc_id: r for r in secret_scan.secret_scan(d, m).collect()}
    assert [i for i in range(1, 41) if got[i].n_secrets != 1] == []
    assert [texts[i - 1] for i in range(41, len(texts) + 1) if got[i].n_secrets] == []
    red = {r.doc_id: r for r in secret_scan.redact(d, m).collect()}
    for i in range(1, 41):
        c = got[i].candidates[0]
        assert texts[i - 1][c.start : c.end] == (hexes + b64)[i - 1]
        assert (hexes + b64)[i - 1] not in red[i].text and "[SECRET]" in red[i].text and red[i].n_chars == len(red[i].text)
    assert all(red[i].text == texts[i - 1] for i in range(41, len(texts) + 1))
    # the cutoff is that of the weighted procedure done directly
    c = [x for r in got.values() for x in r.candidates]
    k = secret_scan.key(np.array([x.p_value for x in c]), np.array([x.end - x.start for x in c]) / m["mean"])
    ok = [q for q in sorted(set(k.tolist())) if math.exp(q / secret_scan.STEP) <= 0.01 * (k <= q).sum() / len(c)]
    assert m["cutoff"] is not None and abs(max(ok) - m["cutoff"]) <= 1


def test_secrets_awkward(spark):
    d = frame(spark)
    m = secret_scan.model(d)
    assert secret_scan.secret_scan(d, m).count() == len(awkward()) and secret_scan.secret_scan(d, m).where("n_secrets > 0").count() == 0
    assert secret_scan.redact(d, m).columns == d.columns and secret_scan.redact(d, m).count() == len(awkward())
    e = secret_scan.model(empty(spark))
    assert e["cutoff"] is None and secret_scan.secret_scan(empty(spark), e).count() == 0


def brute_kneser_ney(texts, discounts):
    """p(byte | context) by the recursive definition, over dictionaries."""
    pads = [b"\0" * (perplexity.ORDER - 1) + t.encode() + b"\3" for t in texts]
    counts = {perplexity.ORDER: {}}
    for p in pads:
        for i in range(perplexity.ORDER - 1, len(p)):
            g = p[i - perplexity.ORDER + 1 : i + 1]
            counts[perplexity.ORDER][g] = counts[perplexity.ORDER].get(g, 0) + 1
    for n in range(perplexity.ORDER - 1, 0, -1):
        counts[n] = {}
        for g in counts[n + 1]:
            counts[n][g[1:]] = counts[n].get(g[1:], 0) + 1

    def prob(g):
        n = len(g)
        if n == 0:
            return 1 / 256
        own = {k: c for k, c in counts[n].items() if k[:-1] == g[:-1]}
        s = sum(own.values())
        if not s:
            return prob(g[1:])
        d = lambda c: discounts[n][min(c, 3) - 1]
        gamma = sum(d(c) for c in own.values()) / s
        c = counts[n].get(g, 0)
        return (max(c - d(c), 0) / s if c else 0) + gamma * prob(g[1:])

    return prob, pads, counts


def test_perplexity_is_kneser_ney(spark):
    texts = ["abab abba", "abba baab", "bab abab", "caba"]
    d = frame(spark, rows(texts))
    got = {r.doc_id: r.perplexity for r in perplexity.perplexity(d).collect()}
    _, _, counts = brute_kneser_ney(texts, {n: (0.5, 1, 1.5) for n in range(1, 6)})
    disc = {}
    for n, t in counts.items():
        n1, n2, n3, n4 = (sum(c == i for c in t.values()) for i in (1, 2, 3, 4))
        if n1 and n2 and n3:
            y = n1 / (n1 + 2 * n2)
            raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
            disc[n] = tuple(max(0.05, min(i - 0.05, x)) for i, x in zip((1, 2, 3), raw))
        else:
            disc[n] = (0.5, 1.0, 1.5)
    prob, pads, _ = brute_kneser_ney(texts, disc)
    for i, p in enumerate(pads, 1):
        lp = [math.log(prob(p[j - 4 : j + 1])) for j in range(4, len(p))]
        assert abs(got[i] - math.exp(-sum(lp) / len(lp))) < 1e-4


def test_bands_by_their_definition(spark):
    """The band from medians of the texts' own scores, done again; what is outside is rejected, and each language has its own."""
    rng = random.Random(2)
    en = [" ".join(words(rng, rng.randint(90, 200))) for _ in range(40)]
    de = [" ".join(w[::-1] for w in words(rng, 120)) for _ in range(20)]
    bad = ["".join(rng.choice("qxzjvkwy#@") for _ in range(900))]
    data = [(i, t, g, "s", 1, 0.5, "x", "y", "z", "w") for i, (t, g) in enumerate([(t, "en") for t in en + bad] + [(t, "de") for t in de] + [("lone text", None), ("single", "fr")], 1)]
    d = frame(spark, data)
    got = perplexity.perplexity(d).collect()
    assert {r.lang for r in got} == {"en", "de", "", "fr"} and [r.doc_id for r in got if r.rejected] == [41]
    w = Work(spark, "test")
    path = perplexity.fit(d, w)
    for g, texts in (("en", en + bad), ("de", de)):
        data, off = toxicity.utf8(pa.array(texts))
        key, first = perplexity.grams(data, off)
        lp = perplexity.log_probs(key, perplexity.language(path, g))
        x = [-lp[a:b].mean() for a, b in zip(first[:-1], first[1:])]
        tau2 = np.mean([lp[a:b].var() for a, b in zip(first[:-1], first[1:])])
        middle = lambda v: sorted(v)[(len(v) - 1) // 2]
        long = [v for v, a, b in zip(x, first[:-1], first[1:]) if b - a >= perplexity.LONG]  # the longer texts set the band, where there are some
        mid = middle(long or x)
        mad = middle([abs(v - mid) for v in long]) if long else 0
        for r in (r for r in got if r.lang == g):
            i = r.doc_id - 1 - (0 if g == "en" else 41)
            s = math.sqrt((1.4826 * mad) ** 2 + 3 * tau2 / (first[i + 1] - first[i]))
            assert abs(r.perplexity - math.exp(x[i])) < 1e-3
            assert abs(math.log(r.low) - (mid - 4 * s)) < 1e-3 and abs(math.log(r.high) - (mid + 4 * s)) < 1e-3
            assert r.rejected or r.low <= r.perplexity <= r.high


def test_unseen_text_backs_off(spark):
    w = Work(spark, "test")
    path = perplexity.fit(frame(spark, rows(["abab abba", "abba"])), w)
    m = perplexity.language(path, "en")
    from tempograph.llm.common import utf8

    data, off = utf8(pa.array(["zzz", "abab"]))
    key, _ = perplexity.grams(data, off)
    lp = perplexity.log_probs(key, m)
    assert np.isfinite(lp).all() and lp[:3].mean() < lp[4:].mean()


def test_perplexity_awkward(spark):
    d = frame(spark)
    got = perplexity.perplexity(d).collect()
    assert len(got) == len(awkward())
    assert all(not r.rejected for r in got if r.doc_id in (1, 2))
    assert perplexity.perplexity(empty(spark)).count() == 0


def test_regular_junk_is_rejected(spark):
    """Junk that is easy to predict byte for byte: tables, marks on each word, repeated words; short and plain texts stay."""
    rng = random.Random(5)
    good = [" ".join(w + rng.choice(["", "", "", "", "", ",", "."]) for w in words(rng, rng.randint(100, 300))) for _ in range(150)]
    table = [" | ".join(words(rng, 150)) for _ in range(8)]
    marks = [" ".join(w + rng.choice(["###", "%%%", "&&&"]) for w in words(rng, 150)) for _ in range(8)]
    again = [" ".join(f"{w} " * 40 for w in words(rng, 4)).strip() for _ in range(8)]
    plain = [" ".join(words(rng, 150)) for _ in range(3)] + ["Les.", "a | b"]
    got = {r.doc_id: r.rejected for r in perplexity.perplexity(frame(spark, rows(good + plain + table + marks + again))).collect()}
    kept = len(good) + len(plain)
    assert [i for i in got if i <= kept and got[i]] == []
    assert [i for i in got if i > kept and not got[i]] == []
