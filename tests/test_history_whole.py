"""Queries of code history over small tables, against brute force over every row."""

import re
from collections import Counter

from tempograph.operators import graph, lineage as L
from tempograph.plans import history
from tempograph.plans.registry import Tables
from tempograph.queries import QUERIES

BRANDS, TYPES, NAMES = ["Brand#1", "Brand#2"], ["SMALL PLATED TIN", "SMALL PLATED BRASS", "LARGE BURNISHED TIN"], ["red bolt", "blue bolt", "green nut", "red nut", "plain cap"]


def tok(x):
    return set(filter(None, re.split("[^a-z0-9_!?*-]+", x.lower())))


def jac(a, b):
    return len(a & b) / len(a | b) if a | b else 1


def num(a, b):
    return max(0, min(1, 1 - abs(a - b) / max(1, a, b)))


def scored(parts):
    """{(from, to): confidence} of the even keys against the odd ones."""
    out = {}
    for k, brand, name, kind, n in parts:
        for k2, brand2, name2, kind2, n2 in parts:
            if brand != brand2 or k % 2 or not k2 % 2:
                continue
            same = float(kind == kind2)
            structure = 1 if name == name2 and same else round(same * 0.45 + jac(tok(kind), tok(kind2)) * 0.3 + num(n, n2) * 0.1 + num(n % 7, n2 % 7) * 0.1 + num(n % 3, n2 % 3) * 0.05, 6)
            total = (1 if name == name2 else jac(tok(name), tok(name2))) * 0.22 + same * 0.15 + structure * 0.28
            total += jac(tok(f"{name} {kind}"), tok(f"{name2} {kind2}")) * 0.12 + jac(tok(kind), tok(kind2)) * 0.14 + jac(tok(kind), tok(kind2)) * 0.04 + 0.05
            if round(total, 6) >= 0.45:
                out[str(k), str(k2)] = round(total, 6)
    return out


def test_fuzzy_lineage_takes_every_part(spark, tmp_path):
    parts = [(k, BRANDS[k // 2 % 2], NAMES[k * k % 5], TYPES[k // 4 % 3], 1 + k * 7 % 50) for k in range(60)]
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_name string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    run = lambda q: QUERIES[q](spark, str(tmp_path)).collect()
    want = scored(parts)
    assert {int(a) % 10 for a, _ in want} == {0, 2, 4, 6, 8} and {int(b) % 10 for _, b in want} == {1, 3, 5, 7, 9}
    got = {(r.from_id, r.to_id): r.confidence for r in run("fuzzy_score_pairs")}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 2e-6 for p in want)
    resolved = {p for p, c in got.items() if not any(q != p and (q[0] == p[0] or q[1] == p[1]) and round(abs(got[q] - c), 6) < 0.05 for q in got)}
    assert {(r.from_id, r.to_id): r.status for r in run("fuzzy_ambiguity")} == {p: "resolved" if p in resolved else "candidate" for p in got}
    assert {(r.from_id, r.to_id) for r in run("lineage_split_merge")} == resolved
    assert {r.id for r in run("lineage_unmatched")} == {str(k) for k in range(0, 60, 2)} - {a for a, _ in resolved}


def test_traces_take_every_customer(spark, tmp_path):
    nations = [(i, n, i % 2) for i, n in enumerate(["JAPAN", "FRANCE", "KENYA", "PERU", "NATION_3"])]
    customers = [(k, f"c{k}", k % 4, -1.0 if k % 3 == 0 else 1.0) for k in range(1, 121) if k % 4 != 3]
    at = str(tmp_path)
    spark.createDataFrame([(0,), (1,)], "r_regionkey int").write.parquet(f"{at}/region.parquet")
    spark.createDataFrame(nations, "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{at}/nation.parquet")
    spark.createDataFrame(customers, "c_custkey long, c_name string, c_nationkey int, c_acctbal double").write.parquet(f"{at}/customer.parquet")
    want = []
    for n, name, region in nations:
        own = sorted((k, debt) for k, _, m, debt in customers if m == n)
        if name in ("JAPAN", "NATION_3"):
            want.append((0, region, [n], "sink", f"r{region}>n{n}"))
        elif not own:
            want.append((1, region, [n], "leaf", f"r{region}>n{n}"))
        for k, debt in own if name not in ("JAPAN", "NATION_3") else []:
            want.append((1 if debt < 0 else 2, region, [n, k], "dynamic" if debt < 0 else "leaf", f"r{region}>n{n}>c{k}"))
    got = {(r.start, r.terminal): r.paths for r in QUERIES["trace_terminals"](spark, at).collect()}
    assert got == Counter((f"r{w[1]}", w[3]) for w in want)
    paths = [(r.position, r.path) for r in QUERIES["trace_paths"](spark, at).orderBy("position").collect()]
    assert paths == [(i, w[4]) for i, w in enumerate(sorted(want)[:50], 1)]


def test_a_count_has_no_limit(spark, tmp_path):
    e = spark.range(200).selectExpr("'a' AS source", "cast(id AS int) AS ordinal", "concat('b', id) AS target", "'b' AS target_name", "'resolved' AS resolution")
    s = spark.createDataFrame([("a",)], "id string")
    assert graph.trace(e, s).count() == 50 and graph.trace(e, s, max_paths=None).count() == 200


def test_equal_parts_are_scored_once(spark, tmp_path):
    one = [(k, BRANDS[k // 2 % 2], NAMES[k * k % 5], TYPES[k // 4 % 3], 1 + k * 7 % 50) for k in range(40)]
    parts = one + [(k + 40, *x) for k, *x in one[:20]] + [(k + 80, *x) for k, *x in one[:8]]
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_name string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    t = Tables(spark, str(tmp_path))
    p, c, r = history._resolved(t)
    single = {(r.from_id, r.to_id) for r in L.score_pairs(*history._sides(Tables(spark, _written(spark, tmp_path / "one", one))), ["block"]).select("from_id", "to_id").collect()}
    assert r.count() == len(single)
    want = scored(parts)
    near = {q: {o for o in want if o != q and (o[0] == q[0] or o[1] == q[1]) and round(abs(want[o] - want[q]), 6) < 0.05} for q in want}
    run = lambda q: QUERIES[q](spark, str(tmp_path)).collect()
    assert {(r.from_id, r.to_id): r.status for r in run("fuzzy_ambiguity")} == {q: "candidate" if near[q] else "resolved" for q in want}
    assert {(r.from_id, r.to_id): r.alternatives for r in run("lineage_alternatives")} == {q: ",".join(f"{a}>{b}" for a, b in sorted(n)) for q, n in near.items() if n}
    assert {(r.from_id, r.to_id) for r in run("lineage_split_merge")} == {q for q in near if not near[q]}
    assert {(r.from_id, r.to_id) for r in run("persisted_lineage") if r.kind == "candidate"} == {q for q in near if near[q]}


def _written(spark, at, parts):
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_name string, p_type string, p_size int").write.parquet(f"{at}/part.parquet")
    return str(at)


def test_range_tasks_have_a_fixed_number_of_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(history, "TASK_ROWS", 50)
    rows = [(k % 60, k % 7, float(k * 13 % 50 + 1)) for k in range(600)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    x = QUERIES["range_enclosing_min"](spark, str(tmp_path))
    assert x.rdd.getNumPartitions() >= 12
    own = {(f, n): min((int(q), m) for g, m, q in rows if g == f and 10 * m <= 10 * n + 5 <= 10 * m + int(q)) for f, n, _ in rows if any(g == f and 10 * m <= 10 * n + 5 <= 10 * m + int(q) for g, m, q in rows)}
    assert {(r.file, r.ref): r.owner for r in x.collect()} == {k: m for k, (_, m) in own.items()}


def test_structural_overlap_pairs_differ_in_size(spark, tmp_path):
    _written(spark, tmp_path, [(1, "Brand#1", "a", "SMALL TIN", 10), (2, "Brand#1", "b", "SMALL BRASS", 5), (3, "Brand#2", "c", "SMALL TIN", 5), (4, "Brand#1", "d", "SMALL TIN", 10)])
    got = {(r.a, r.b): (r.overlap, r.size_similarity) for r in QUERIES["structural_overlap_pairs"](spark, str(tmp_path)).collect()}
    assert got == {(1, 2): (0.5, 0.5), (1, 4): (1.0, 1.0), (2, 4): (0.5, 0.5)}
