"""The logical fixtures of the operators, as literals."""

import json

import pytest
from pyspark.sql import functions as F

from tempograph.functions import similarity as S, text as X
from tempograph.operators import context, conversations as C, fts, graph, lineage as L, textgraph, topics as T, vectors as V


def test_exact_transitions(spark):
    o = spark.createDataFrame([(1, "L", "A", "core"), (2, "L", "B", "core"), (3, "L", "B", "renamed"), (5, "L", "B", "resurrected")], "seq long, logical string, revision string, path string")
    d = spark.createDataFrame([(4, "renamed")], "seq long, path string")
    got = [r.kind for r in L.exact_transitions(o, d).orderBy("seq").collect()]
    assert got == ["introduced", "modified", "moved", "deleted", "resurrected"]


SYM = "block string, id string, name string, kind string, signature string, structural_hash string, shape_hash string, features array<string>, node_count int, depth int, arity int, content string, references array<string>, changed_paths array<string>"


def sym(id_, name, h="shape-1", sig="[config]", content="parse config load"):
    return ("b", id_, name, "function", sig, h, "shape-tree-1", [":call", ":map", ":symbol"], 12, 4, 1, content, ["example.core/load-config"], ["src/config.clj"])


def resolved(spark, prev, cur, ambiguity=0.05):
    p, c = (spark.createDataFrame(x, SYM) for x in (prev, cur))
    s = L.score_pairs(p, c, ["block"])
    r = L.resolve(s, ["block"], ambiguity)
    return s, r, L.match(r, ["block"])


def test_rename_is_moved(spark):
    s, _, m = resolved(spark, [sym("p", "parse-config")], [sym("c", "parse-options", "shape-2")])
    e = s.first()
    assert e.e_structure > 0.8 and e.e_signature == e.e_references == e.e_diff == 1 and e.confidence > 0.45
    assert [r.kind for r in m.collect()] == ["moved"]


def test_split_merge_and_ambiguity(spark):
    one, two = [sym("p", "parse-config")], [sym("c1", "parse-config-header", "shape-2"), sym("c2", "parse-config-body", "shape-3", "[config body]")]
    assert [r.kind for r in resolved(spark, one, two, 0.02)[2].collect()] == ["split", "split"]
    assert [r.kind for r in resolved(spark, two, one, 0.02)[2].collect()] == ["merge", "merge"]
    same = [sym("c1", "parse-options", "shape-2"), sym("c2", "parse-settings", "shape-3")]
    _, r, m = resolved(spark, one, same)
    assert m.count() == 0 and {x.status for x in r.collect()} == {"candidate"}
    assert L.unmatched(spark.createDataFrame(same, SYM), m, ["block"], "to_id").count() == 2


EDGES = "source string, ordinal int, target string, target_name string, resolution string"


def test_trace(spark):
    e = spark.createDataFrame([("start", 0, "worker", "app/worker", "resolved"), ("worker", 0, "write", "app/write", "resolved"), ("worker", 1, None, "eval", "dynamic"), ("worker", 2, "start", "app/start", "resolved")], EDGES)
    s = spark.createDataFrame([("start",)], "id string")
    assert [r.terminal for r in graph.trace(e, s, ["app/write"]).orderBy("position").collect()] == ["sink", "dynamic", "cycle"]
    cyc = spark.createDataFrame([("a", 0, "b", "b", "resolved"), ("b", 0, "a", "a", "resolved")], EDGES)
    assert [r.terminal for r in graph.trace(cyc, spark.createDataFrame([("a",)], "id string"), max_depth=1, max_paths=1).collect()] == ["max-depth"]


def test_bm25_order_and_phrases(spark):
    d = spark.createDataFrame([(1, "parse config now"), (2, "config parse"), (3, "render page"), (4, "other words here")], "id long, text string")
    assert [r.id for r in fts.bm25(d, "id", F.col("text"), ["parse config"]).collect()] == [1]
    assert {r.id for r in fts.bm25(d, "id", F.col("text"), ["parse"]).collect()} == {1, 2}
    assert fts.bm25(d, "id", F.col("text"), ["absent"]).count() == 0
    lengths = d.select("id", F.size(fts.tokens(F.col("text"))).alias("len"))
    a = fts.search_postings(fts.postings(d, "id", {"text": F.col("text")}), lengths, "id", ["parse", "page"]).collect()
    assert [(r.id, r.score) for r in a] == [(r.id, r.score) for r in fts.bm25(d, "id", F.col("text"), ["parse", "page"]).collect()]


def test_similarity(spark):
    r = spark.range(1).select(S.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("j"), S.overlap(F.array().cast("array<string>"), F.array(F.lit("a"))).alias("o"), S.numeric_similarity(F.lit(None).cast("int"), F.lit(3)).alias("n"), S.cosine(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0))).alias("c")).first()
    assert tuple(r) == (1.0, 0.0, 0.0, 0.0)


def test_text_graph_anchors_and_layers(spark):
    t = "🙂 Please link acme/tools to the room. I don't want the old graphs. Does it work?"
    a, n, e = textgraph.graph(t)
    raw = t.encode()
    by = {x["id"]: x for x in a}
    for x in n:
        for i in x["anchors"]:
            assert raw[by[i]["start_byte"] : by[i]["end_byte"]].decode()
    kinds = {x["kind"] for x in n}
    assert {"request", "rejection", "question", "repository", "proposition"} <= kinds
    ids = {x["id"] for x in n}
    assert all(x["from"] in ids and x["to"] in ids for x in e)
    prop = lambda s: [x["id"] for x in textgraph.graph(s)[1] if x["kind"] == "proposition"]
    assert prop("Keep the graphs.") == prop("Keep the graphs!")
    g = textgraph.graphs(spark.createDataFrame([("r", t)], "revision string, content string"))
    layers = lambda p: {r.layer for r in graph.project(textgraph.nodes(g), textgraph.edges(g), p).collect()}
    assert layers("source") == {"source"} and layers("concepts") == {"reference", "semantic"} and "source" not in layers("work") and "work" in layers("work")


def test_sentences_and_phrases(spark):
    spans = X.sentence_spans('He said "no." Then left.\n你好。再见！ a.b c')
    assert [('He said "no." Then left.\n你好。再见！ a.b c')[a:b] for a, b in spans] == ['He said "no."', "Then left.", "你好。", "再见！", "a.b c"]
    r = spark.createDataFrame([("We should link topics to private agent rooms for better ranked searches.",)], "t string").select(X.phrase_candidates(F.col("t")).alias("p")).first()
    assert "private agent rooms" in [x.label for x in r.p]
    assert X.truncate_utf8("aé🙂", 4) == "aé" and X.truncate_tokens("x" * 100, 5)[1]


def test_topics_fold(spark):
    m = spark.createDataFrame([(1, "a", 1.0), (1, "b", 4.0), (2, "b", 1.0), (3, "a", 1.0)], "message long, topic string, weight double").withColumn("graph", F.col("message")).withColumn("context", F.col("message"))
    r = T.associations(m, spark.createDataFrame([(3, 2)], "from_message long, to_message long"), m.groupBy("topic").agg(F.count("*").alias("df"))).first()
    assert (r["left"], r["right"], r.weighted_support, r.support) == ("a", "b", 4 * 2 + 0.75 * 2 + 1.5, 3)


def test_records_and_windows(spark):
    rec = spark.createDataFrame([(1, 5, "a", False), (1, 7, "b", True), (2, 5, "a", False), (2, 5, "c", False)], "id long, updated_at long, payload string, deleted boolean")
    assert {(r.id, r.payload, r.deleted) for r in C.merge_records(rec, 10).collect()} == {(1, "b", True), (2, "c", False)}
    with pytest.raises(ValueError):
        C.filtered(rec, since=2, until=1)
    msg = spark.createDataFrame([("q", 0, 1, i, f"r{i}", "word " * n) for i, n in enumerate((100, 100, 400))], "query string, priority int, position int, message long, revision string, content string")
    out = context.pack(msg, budget=512).collect()
    assert [r.citation for r in out] == ["H1", "H2", "H3"] and [r.truncated for r in out] == [False, False, True] and sum(r.cost for r in out) + context.BASE <= 512


def test_vectors(spark):
    d = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "id long, t string").select("id", V.deterministic(8)("t").alias("v")).collect()
    assert d[0].v == d[1].v and d[2].v is None and abs(sum(x * x for x in d[0].v) - 1) < 1e-9
    v = spark.createDataFrame([(1, [0.5, -2.0])], "vec_id long, embedding array<float>")
    assert v.select(V.decode_f32(V.encode_f32("embedding")).alias("x")).first().x == [0.5, -2.0]


def test_ids():
    from tempograph.functions.ids import canonical

    assert canonical({"b": 1, "a": [float("nan"), b"x", None]}) == '{"a":[null,{"base64":"eA=="},null],"b":1}'
    assert json.loads(canonical({"x": 1.0})) == {"x": 1}


def test_postings_group_words_and_give_lengths(spark):
    docs = spark.createDataFrame([(i, t, "fr") for i, t in enumerate(["b a b", "", None, "a é E " + "x " * 300])] + [(i, f"w{i % 3} a", "de") for i in range(4, 700)], "id int, text string, lang string").coalesce(1)
    fields = {"text": F.col("text"), "lang": F.col("lang")}
    p = fts.postings(docs, "id", fields)
    got = {(r.id, r.field, r.term): r.positions for r in p.collect()}
    assert got[0, "text", "b"] == [1, 3] and got[3, "text", "e"] == [2, 3] and got[3, "text", "x"] == list(range(4, 304)) and got[699, "text", "a"] == [2]
    assert len(got) == 3 + 1 + 1 + 4 + 3 * 696 and (1, "text", "") not in got
    assert sorted(fts.indexed_lengths(p, docs, "id").collect()) == sorted(fts.field_lengths(docs, "id", fields).collect())


def test_projection_of_messages_is_that_of_tables(spark):
    texts = ["Please fix a/b/c.py. We decided to use @x/y because it works. See https://github.com/a/b.", "Nothing here.", "Is é done? Ship é/f.py now, it must pass.", ""]
    m = spark.createDataFrame([(f"r{i}", t) for i, t in enumerate(texts)], "revision string, content string")
    g = textgraph.graphs(m)
    for layer in ("concepts", "work"):
        want = {(r.graph, r.id) for r in graph.project(textgraph.nodes(g), textgraph.edges(g), layer).collect()}
        assert want and {(r.graph, r.id) for r in textgraph.project(m, layer).collect()} == want
    plan = textgraph.project(m, "work")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Join" not in plan
