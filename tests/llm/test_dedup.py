import hashlib

import numpy as np
import pyarrow as pa
import pytest

from tempograph.llm import near_dedup, substring_dedup

from .helpers import awkward, empty, frame, rows


def words(n, seed):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice([f"w{i}" for i in range(400)], n))


def edited(text, k, seed):
    w, rng = text.split(), np.random.default_rng(seed)
    for i in rng.choice(len(w), k, replace=False):
        w[i] = f"x{i}"
    return " ".join(w)


def edit_distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        c = [i]
        for j, y in enumerate(b, 1):
            c.append(min(p[j] + 1, c[-1] + 1, p[j - 1] + (x != y)))
        p = c
    return p[-1]


def test_banded_alignment_is_edit_distance():
    rng = np.random.default_rng(0)
    pairs, want = [], []
    for _ in range(300):
        a = rng.integers(0, 5, rng.integers(0, 30)).astype(np.uint64)
        b = a.copy()
        for _ in range(rng.integers(0, 9)):
            k = rng.integers(0, 3)
            if k == 0 and len(b):
                b = np.delete(b, rng.integers(0, len(b)))
            elif k == 1:
                b = np.insert(b, rng.integers(0, len(b) + 1), rng.integers(0, 5))
            elif len(b):
                b[rng.integers(0, len(b))] = rng.integers(0, 5)
        pairs.append((a, b))
        want.append(edit_distance(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9))
    assert near_dedup.within(pairs, 0.8).tolist() == want


def test_near_groups_match_brute_force(spark):
    texts = [words(60, i) for i in range(30)]
    texts += [edited(texts[i], k, i) for i, k in ((0, 1), (0, 3), (1, 5), (2, 6), (3, 20))] + [texts[4], texts[4]]
    texts += [edited(texts[5], 1, 100 + j) for j in range(40)]  # a family larger than a small bucket
    passage = words(40, 999)
    texts += [words(30, 200 + j) + " " + passage for j in range(25)]  # a shared passage makes no near copies
    got = {r.doc_id: r.group_id for r in near_dedup.near_dedup(frame(spark, rows(texts))).collect()}
    split = [t.split() for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if edit_distance(split[i], split[j]) <= 0.2 * max(len(split[i]), len(split[j])) + 1e-9:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    size = {}
    for i in range(len(texts)):
        size[find(i)] = size.get(find(i), 0) + 1
    want = {i + 1: find(i) + 1 for i in range(len(texts)) if size[find(i)] > 1}
    assert got == want


def groups_of(split):
    """The smallest number of each text's component over all pairs, for components of two or more."""
    parent = list(range(len(split)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(split)):
        for j in range(i):
            n = max(len(split[i]), len(split[j]))
            if abs(len(split[i]) - len(split[j])) <= 0.2 * n and edit_distance(split[i], split[j]) <= 0.2 * n + 1e-9:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    own = [find(i) for i in range(len(split))]
    return {i + 1: g + 1 for i, g in enumerate(own) if own.count(g) > 1}


@pytest.mark.parametrize("block", [4, 256])
def test_near_in_crowded_buckets(spark, monkeypatch, block):
    """A passage is most of many texts, so all their bands are crowded; a family of copies stands among them, and copies differ in what is their own."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    passage = words(40, 999)
    own = [words(14, 300 + j) for j in range(30)]
    texts = [f"{x} {passage}" for x in own] + [f"{edited(x, 4, j)} {passage}" for j, x in enumerate(own[:12])]
    texts += [edited(f"{passage} {words(13, 77)}", 2, 500 + j) for j in range(20)]
    got = {r.doc_id: r.group_id for r in near_dedup.near_dedup(frame(spark, rows(texts))).collect()}
    want = groups_of([t.split() for t in texts])
    assert len(set(want.values())) > 8
    # bands are approximate: who shares none is not found; whoever shares one is
    h = [near_dedup.words(*near_dedup.utf8(pa.array([t]))) for t in texts]
    bands = [set(enumerate(near_dedup.sketch(*near_dedup.kmers(x[2], x[3], 3), 20)[0].tolist())) for x in h]
    assert all(any(bands[i] & bands[j] for j in range(len(texts)) if j != i) for i in range(len(texts)))
    assert got == want


def test_bounds_settle_what_is_plain(monkeypatch):
    """Texts of one small vocabulary that are no copies, and copies with few edits, need no band; what is near the threshold is aligned and right."""
    banded, band = [], near_dedup._band
    monkeypatch.setattr(near_dedup, "_band", lambda a, la, *rest: banded.append(len(la)) or band(a, la, *rest))
    h = lambda t: near_dedup.words(*near_dedup.utf8(pa.array([t])))[2]
    texts = [words(900, 700 + i) for i in range(12)]
    pairs = [(h(texts[i]), h(texts[i + 1])) for i in range(11)] + [(h(t), h("front " + edited(t, 20, i).replace("x7", "x7 more"))) for i, t in enumerate(texts)]
    assert near_dedup.within(pairs, 0.8).tolist() == [False] * 11 + [True] * 12 and banded == []
    rng, pairs = np.random.default_rng(5), []
    for _ in range(60):
        a = rng.integers(0, 40, 120).astype(np.uint64)
        b = a.copy()
        for _ in range(rng.integers(18, 34)):
            at = rng.integers(0, len(b))
            b = (np.delete(b, at), np.insert(b, at, rng.integers(0, 40)).astype(np.uint64), np.where(np.arange(len(b)) == at, 41, b).astype(np.uint64))[rng.integers(0, 3)]
        pairs.append((a, b))
    want = [edit_distance(a.tolist(), b.tolist()) <= int(0.2 * max(len(a), len(b)) + 1e-9) for a, b in pairs]
    assert near_dedup.within(pairs, 0.8).tolist() == want and 5 < sum(want) < 55


def test_crowded_candidates_not_by_chance(spark):
    """Long texts of one vocabulary have all their words and their histograms alike; only the copy is a candidate, so pairs don't grow with the square of the table."""
    texts = [words(1500, 800 + i) for i in range(40)]
    texts.append(edited(texts[3], 200, 1))
    crowd = spark.createDataFrame(list(enumerate(texts, 1)), "id long, x string")
    got = near_dedup._crowded(near_dedup.Work(spark, "test"), crowd, spark.createDataFrame([], "id long, g long"), 0.8).collect()
    assert [(r.a, r.b) for r in got] == [(4, 41)]


def test_crowded_candidates_meet_more_than_once(spark):
    """Long texts of a few words share some of their rarest runs by chance and are no candidates; the copy is one, with nearly as many edits as the threshold allows."""
    texts = [" ".join(np.random.default_rng(i).choice([f"w{k}" for k in range(150)], 1500)) for i in range(20)]
    texts.append(edited(texts[3], 290, 1))
    crowd = spark.createDataFrame(list(enumerate(texts, 1)), "id long, x string")
    got = near_dedup._crowded(near_dedup.Work(spark, "test"), crowd, spark.createDataFrame([], "id long, g long"), 0.8).collect()
    assert [(r.a, r.b) for r in got] == [(4, 21)]


@pytest.mark.parametrize(("threshold", "q"), [(0.8, 2), (0.7, 2), (0.5, 1)])
def test_rarest_of_near_texts_meet(threshold, q):
    """Texts at the threshold, whose edits lie apart so that each takes away as many runs as it can, meet in as many of their rarest runs as is asked for, whatever the order."""
    rng = np.random.default_rng(7)
    for n in (4, 5, 6, 9, 10, 15, 40, 101, 300):
        for vocabulary in (3, 1000):
            x = rng.integers(0, vocabulary, n)
            k = int((1 - threshold) * n + 1e-9)
            y = x.astype(object)
            y[np.arange(k) * n // max(k, 1)] = [f"new{i}" for i in range(k)]
            less = [w for w in y if not str(w).startswith("new")]
            text = pa.array([" ".join(map(str, v)) for v in (x, y, less)])
            out = near_dedup._rarest(rng.integers(0, 5, near_dedup.COUNTERS), threshold, q).func(text).to_pylist()
            for other in out[1:]:
                meet = near_dedup._common(np.array([other["n"]]), threshold, q)[1][0]
                assert len({*out[0]["ws"]} & {*other["ws"]}) >= meet >= 1 or k == 0


def test_near_awkward(spark):
    d = frame(spark)
    got = {(r.doc_id, r.group_id, r.kept) for r in near_dedup.near_dedup(d).collect()}
    assert got == {(4, 4, True), (5, 4, False)}
    kept = near_dedup.keep_first(d)
    assert kept.columns == d.columns and kept.count() == len(awkward()) - 1
    assert near_dedup.near_dedup(empty(spark)).count() == 0 and near_dedup.keep_first(empty(spark)).count() == 0


PASSAGE = [f"p{i}{'.' if i % 9 == 8 else ''}" for i in range(55)]


def host(n, seed):
    return " ".join(f"h{seed}x{i}" for i in range(n))


def brute_units(text):
    """[first word's start, words], by the definition, a character at a time."""
    tok, i = [], 0
    while i < len(text):
        c = text[i]
        solo = "\u0e00" <= c <= "\u0eff" or "\u3000" <= c <= "\ud7ff"
        if solo:
            tok.append([i, c, ""])
        elif (c.isascii() and c.isalnum()) or not c.isascii():
            if tok and not tok[-1][2] and tok[-1][0] + len(tok[-1][1]) == i and not ("\u0e00" <= tok[-1][1][-1] <= "\u0eff" or "\u3000" <= tok[-1][1][-1] <= "\ud7ff"):
                tok[-1][1] += c
            else:
                tok.append([i, c, ""])
        elif tok:
            tok[-1][2] += c
        i += 1
    out, cur = [], None
    for j, (at, w, gap) in enumerate(tok):
        w = w.lower()
        cur = cur or [at, []]
        cur[1].append(w)
        ends = any(c in ".!?" for c in gap)
        before = j > 0 and any(c in ".!?" for c in tok[j - 1][2])
        few = hashlib.md5(w.encode()).hexdigest()[0] in "01" and (j == 0 or tok[j - 1][1].lower() != w)
        if few or (ends and not before) or j == len(tok) - 1:
            out.append((cur[0], tuple(cur[1])))
            cur = None
    return out


def brute_dedup(docs, least=30):
    """{doc_id: (text, n_removed, kept)} for distinct doc_ids that aren't null."""
    first, out = {}, {}
    for i, t in sorted(docs):
        for x, (_, u) in enumerate(brute_units(t or "")):
            first.setdefault(u, (i, x))
    for i, t in docs:
        un = brute_units(t or "")
        rep = [first[u] != (i, x) for x, (_, u) in enumerate(un)]
        gone, a = [], 0
        while a < len(un):
            b = a
            while b < len(un) and rep[b] == rep[a]:
                b += 1
            if rep[a] and sum(len(u) for _, u in un[a:b]) >= least:
                gone.append((un[a][0], un[b][0] if b < len(un) else len(t), b - a))
            a = b
        at, keep = 0, []
        for a, b, _ in gone:
            if a > at:
                keep.append((at, a))
            at = b
        if t and at < len(t):
            keep.append((at, len(t)))
        out[i] = ("".join(t[a:b] for a, b in keep) if gone else t, sum(g[2] for g in gone), ",".join(f"{a}-{b}" for a, b in keep))
    return out


def dedup(spark, data):
    return {r.doc_id: (r.text, r.n_removed, r.kept) for r in substring_dedup.substring_dedup(frame(spark, data)).collect()}


def test_substring_matches_brute_force(spark):
    p = " ".join(PASSAGE)
    wrapped = "\n".join(" ".join(PASSAGE[i : i + 6]) for i in range(0, 55, 6))
    cjk = "".join(chr(0x4E00 + (i * 37) % 900) for i in range(80))
    thai = "".join(chr(0x0E01 + i % 40) for i in range(50))
    texts = [f"{host(20, 1)} {p} {host(9, 2)}", f"{host(30, 3)} {wrapped.upper()}\n{host(12, 4)}", f"{host(5, 5)}, {p}", "Licensed under the licence. " + host(40, 6), "Licensed under the licence. " + host(40, 7)]
    texts += [host(4, 8) + cjk + host(3, 9), cjk + "。", f"{p} x {p}", "!! ".join(f"W{i % 7}" for i in range(200)), "word " * 300, thai + "é" + cjk, "K\u212a \u0130stanbul " + p, "", "...", None]
    rng = np.random.default_rng(3)
    texts += [" ".join(rng.choice(["aa", "bb", "cc.", "dd", "\u00e9\u00e9!", "\u4f60", "ff\n"], 120)) for _ in range(12)]
    got = dedup(spark, rows(texts))
    want = brute_dedup(list(enumerate(texts, 1)))
    assert {k: v for k, v in got.items() if v != want[k]} == {}
    assert got[1][1] == 0 and all(got[i][1] > 0 for i in (2, 3, 7, 8, 12)) and got[4][1] == got[5][1] == 0
    assert "p30" not in got[2][0].lower() and got[2][0].startswith(host(30, 3))


def test_substring_awkward(spark):
    d = frame(spark)
    got = {(r.doc_id, r.text, r.n_removed, r.kept) for r in substring_dedup.substring_dedup(d).collect()}
    line = "one two three four five six seven eight nine ten\nsecond line here"
    assert (4, line, 0, f"0-{len(line)}") in got and (5, line, 0, f"0-{len(line)}") in got and (None, line, 0, f"0-{len(line)}") in got
    assert (2, None, 0, "") in got and (1, "", 0, "") in got
    assert substring_dedup.substring_dedup(d).count() == len(awkward())
    kept = substring_dedup.drop_repeats(d)
    assert kept.columns == d.columns and kept.dtypes == d.dtypes and kept.count() == len(awkward())
    assert substring_dedup.substring_dedup(empty(spark)).count() == 0 and substring_dedup.drop_repeats(empty(spark)).count() == 0


def test_null_and_equal_ids(spark):
    p = " ".join(PASSAGE)
    null = (None, p + " tail", *rows([""])[0][2:])
    other = (3, "front " + p, *rows([""])[0][2:])
    # null ids rank last and take nothing from each other; so do rows with one id
    got = [(r.doc_id, r.n_removed > 0) for r in substring_dedup.substring_dedup(frame(spark, [null, null])).collect()]
    assert got == [(None, False)] * 2
    got = sorted((r.doc_id or 0, r.n_removed > 0) for r in substring_dedup.substring_dedup(frame(spark, [null, other, other, (3, p, *other[2:]), (7, p, *other[2:])])).collect())
    assert got == [(0, True), (3, False), (3, False), (3, False), (7, True)]


def test_whole_copies_go(spark):
    p = " ".join(PASSAGE)
    kept = {r.doc_id: (r.text, r.n_chars) for r in substring_dedup.drop_repeats(frame(spark, rows([p, p, "new start. " + p]))).collect()}
    assert set(kept) == {1, 3} and kept[1] == (p, len(p)) and kept[3][1] == len(kept[3][0]) < 60


@pytest.mark.parametrize("k", [1, 3])
def test_kmers_of_short_texts(k):
    h, first = np.arange(1, 4, dtype=np.uint64), np.array([0, 0, 1, 3])
    v, start = near_dedup.kmers(h, first, k)
    assert np.diff(start).tolist() == [0, 1, max(1, 3 - k)]
    assert near_dedup.sketch(v, start, 4).shape == (2, 4)
