"""Full-text, ranking, similarity and vector queries."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..functions import similarity as S, text as X
from ..operators import fts, lineage as L, rank, vectors as V
from .registry import Tables, query

Q = ["anon", "ention", "erthe", "que"]
QV = [((i * 37) % 11 - 5) / 10 for i in range(64)]
QV_SQL = "[" + ", ".join(map(str, QV)) + "]::DOUBLE[]"


@query(fts.bm25_sql("documents", "doc_id", "text", Q, 20, "lang"))
def fts_documents_topk(t: Tables):
    return fts.bm25(t.documents, "doc_id", F.col("text"), Q, keep=["lang"])


@query(fts.bm25_sql("(SELECT event_id, event_type || ' ' || props AS m FROM events)", "event_id", "m", ["purchase", "7"], 20))
def fts_commit_topk(t: Tables):
    return fts.bm25(t.events.withColumn("m", F.concat_ws(" ", "event_type", "props")), "event_id", F.col("m"), ["purchase", "7"])


@query(fts.bm25_sql("(SELECT conv_id * 1000 + turn AS message, role || ' ' || text AS m FROM conversations)", "message", "m", ["assistant", "anon", "tion"], 20))
def fts_message_topk(t: Tables):
    m = t.messages().withColumn("m", F.concat_ws(" ", "role", "content"))
    return fts.bm25(m, "message", F.col("m"), ["assistant", "anon", "tion"])


@query(fts.bm25_sql("documents", "doc_id", "text", ["of the", "anon"], 20))
def fts_phrase_topk(t: Tables):
    return fts.bm25(t.documents, "doc_id", F.col("text"), ["of the", "anon"])


@query("""
SELECT p_partkey, p_name, CASE WHEN lower(p_name) = lower(x.q) THEN 0 WHEN starts_with(lower(p_name), lower(x.q)) THEN 1 ELSE 2 END AS tier
FROM part, (SELECT min(p_name) AS q FROM part) x
WHERE contains(lower(p_name), split_part(lower(x.q), ' ', 1)) ORDER BY tier, p_name, p_partkey LIMIT 20""")
def fts_topic_exact_tier(t: Tables):
    q = t.part.agg(F.min("p_name").alias("q"))
    n, lq = F.lower("p_name"), F.lower("q")
    x = t.part.crossJoin(F.broadcast(q)).where(n.contains(F.split(lq, " ")[0]))
    tier = F.when(n == lq, 0).when(n.startswith(lq), 1).otherwise(2)
    return x.select("p_partkey", "p_name", tier.alias("tier")).orderBy("tier", "p_name", "p_partkey").limit(20)


@query(f"""
WITH a AS ({fts.bm25_sql('documents', 'doc_id', 'text', ['anon'], 10)}), b AS ({fts.bm25_sql("(SELECT conv_id * 1000 + turn AS message, text FROM conversations)", 'message', 'text', ['anon'], 10)})
SELECT 'revision' AS kind, doc_id AS id, score, CAST(row_number() OVER (ORDER BY score, doc_id) AS INTEGER) AS rank FROM a
UNION ALL SELECT 'commit', message, score, CAST(row_number() OVER (ORDER BY score, message) AS INTEGER) FROM b""")
def retrieve_union_docs(t: Tables):
    a = rank.ranked(fts.bm25(t.documents, "doc_id", F.col("text"), ["anon"], 10), "score", "doc_id", limit=10)
    b = rank.ranked(fts.bm25(t.messages(), "message", F.col("content"), ["anon"], 10), "score", "message", limit=10)
    return a.select(F.lit("revision").alias("kind"), F.col("doc_id").alias("id"), "score", "rank").unionByName(b.select(F.lit("commit").alias("kind"), F.col("message").alias("id"), "score", "rank"))


@query(f"""
WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY score, doc_id) AS r FROM ({fts.bm25_sql('documents', 'doc_id', 'text', ['anon'], 30)})),
b AS (SELECT doc_id, row_number() OVER (ORDER BY score, doc_id) AS r FROM ({fts.bm25_sql('documents', 'doc_id', 'text', ['ention'], 30)})),
u AS (SELECT doc_id, r, 'first' AS s FROM a UNION ALL SELECT doc_id, r, 'second' FROM b)
SELECT doc_id, round(sum(1.0::DOUBLE / (60 + r)), 6) AS fused, string_agg(s, ',' ORDER BY s) AS sources FROM u GROUP BY doc_id""")
def rrf_two_lists(t: Tables):
    lists = {n: rank.ranked(fts.bm25(t.documents, "doc_id", F.col("text"), [q], 30), "score", "doc_id", limit=30) for n, q in (("first", "anon"), ("second", "ention"))}
    return rank.reciprocal_rank_fusion(lists, "doc_id")


@query(f"""
WITH a AS (SELECT doc_id AS id, row_number() OVER (ORDER BY score, doc_id) AS r FROM ({fts.bm25_sql('documents', 'doc_id', 'text', ['anon'], 30)})),
e AS (SELECT vec_id AS id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), {QV_SQL}), 6) AS s FROM embeddings),
b AS (SELECT id, row_number() OVER (ORDER BY s DESC, id) AS r FROM e ORDER BY r LIMIT 30),
u AS (SELECT id, r, 'lexical' AS s FROM a UNION ALL SELECT id, r, 'dense' FROM b)
SELECT id, round(sum(1.0::DOUBLE / (60 + r)), 6) AS fused, string_agg(s, ',' ORDER BY s) AS sources FROM u GROUP BY id""")
def hybrid_lexical_dense(t: Tables):
    a = rank.ranked(fts.bm25(t.documents, "doc_id", F.col("text"), ["anon"], 30), "score", "doc_id", limit=30).withColumnRenamed("doc_id", "id")
    b = rank.ranked(V.dense_topk(t.embeddings, QV, 30), F.desc("similarity"), "vec_id", limit=30).withColumnRenamed("vec_id", "id")
    return rank.reciprocal_rank_fusion({"lexical": a, "dense": b}, "id")


@query(f"""
WITH m AS (SELECT conv_id * 1000 + turn AS message, text FROM conversations),
a AS (SELECT message, score, row_number() OVER (ORDER BY score, message) AS r FROM ({fts.bm25_sql('m', 'message', 'text', ['anon'], 40)})),
b0 AS (SELECT message, round(1 - exp(-len(list_filter(regexp_extract_all({fts.fold_sql('text')}, '{fts.TOKEN}'), lambda x: starts_with(x, 'ent'))) / 3.0::DOUBLE), 6) AS s FROM m),
b AS (SELECT message, s, row_number() OVER (ORDER BY s DESC, message) AS r FROM b0 WHERE s > 0 ORDER BY r LIMIT 40)
SELECT coalesce(a.message, b.message) AS message, CAST(a.r AS INTEGER) AS lexical_rank, score AS bm25, CAST(b.r AS INTEGER) AS topic_rank, s AS topic_score,
  round(coalesce(1.0::DOUBLE / (60 + a.r), 0) + coalesce(0.85::DOUBLE / (60 + b.r) + 0.01::DOUBLE * s, 0), 6) AS fused
FROM a FULL JOIN b ON a.message = b.message""")
def chat_fused_search(t: Tables):
    a = rank.ranked(fts.bm25(t.messages(), "message", F.col("content"), ["anon"], 40), "score", "message", limit=40)
    s = F.round(S.saturating(F.size(F.filter(fts.tokens(F.col("content")), lambda w: w.startswith("ent"))).cast("double")), 6)
    b = rank.ranked(t.messages().select("message", s.alias("score")).where("score > 0"), F.desc("score"), "message", limit=40)
    return rank.fused_search(a, b, "message")


_PART = "split(p_type, ' ')"


@query("""
WITH c AS (SELECT p_partkey AS id, CAST(row_number() OVER (ORDER BY p_partkey) AS INTEGER) AS rank, list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9_]+')) AS tokens,
  p_brand AS kind, split_part(p_name, ' ', 1) AS ns, list_distinct(string_split(p_type, ' ')) AS f, p_size AS n FROM part),
t AS (SELECT * FROM c WHERE id = (SELECT min(p_partkey) FROM part)),
x AS (SELECT c.id, c.rank, CASE WHEN len(c.tokens) > 0 AND len(t.tokens) > 0 THEN len(list_intersect(c.tokens, t.tokens))::DOUBLE / greatest(len(c.tokens), len(t.tokens)) ELSE 0 END AS nm,
  (c.kind = t.kind)::INT AS k, (c.ns = t.ns)::INT AS s,
  0.65::DOUBLE * (len(list_intersect(c.f, t.f))::DOUBLE / greatest(len(c.f), len(t.f))) + 0.15::DOUBLE * greatest(0, least(1, 1 - abs(c.n - t.n)::DOUBLE / greatest(1, c.n, t.n)))
  + 0.10::DOUBLE * greatest(0, least(1, 1 - abs(c.n % 7 - t.n % 7)::DOUBLE / greatest(1, c.n % 7, t.n % 7))) + 0.10::DOUBLE * greatest(0, least(1, 1 - abs(c.n % 3 - t.n % 3)::DOUBLE / greatest(1, c.n % 3, t.n % 3))) AS st
  FROM c, t WHERE c.id <> t.id)
SELECT id, round(st, 6) AS structural, round(0.30::DOUBLE / rank + 0.25::DOUBLE * nm + 0.15::DOUBLE * k + 0.05::DOUBLE * s + 0.25::DOUBLE * st, 6) AS score FROM x ORDER BY score DESC, id LIMIT 20""")
def similar_symbols_rescored(t: Tables):
    p = t.part
    first = p.agg(F.min("p_partkey").alias("m"))
    # the lexical rank is that of the candidates in order; the part table is the bounded candidate list here
    c = p.select(F.col("p_partkey").alias("id"), F.row_number().over(W.orderBy("p_partkey")).alias("rank"), X.similarity_tokens(F.col("p_name")).alias("tokens"), F.col("p_brand").alias("kind"), F.split("p_name", " ")[0].alias("namespace"), F.array_distinct(F.split("p_type", " ")).alias("features"), F.col("p_size").alias("node_count"), (F.col("p_size") % 7).alias("depth"), (F.col("p_size") % 3).alias("arity"))
    return rank.similar_symbols(c, c.join(F.broadcast(first), F.col("id") == F.col("m"), "left_semi"))


@query("""
WITH p AS (SELECT p_partkey AS id, p_brand, list_distinct(string_split(p_type, ' ')) AS f, p_size AS n FROM part)
SELECT a.id AS a, b.id AS b, round(len(list_intersect(a.f, b.f))::DOUBLE / greatest(len(a.f), len(b.f)), 6) AS overlap,
  round(greatest(0, least(1, 1 - abs(a.n - b.n)::DOUBLE / greatest(1, a.n, b.n))), 6) AS size_similarity,
  round(CASE WHEN len(list_distinct(list_concat(a.f, b.f))) > 0 THEN len(list_intersect(a.f, b.f))::DOUBLE / len(list_distinct(list_concat(a.f, b.f))) ELSE 1 END, 6) AS jaccard
FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.id < b.id""")
def structural_overlap_pairs(t: Tables):
    p = t.part.select(F.col("p_partkey").alias("id"), "p_brand", F.array_distinct(F.split("p_type", " ")).alias("f"), F.col("p_size").alias("n"))
    a, b = (p.select(F.col("id").alias(x), F.col("f").alias(f"f{x}"), F.col("n").alias(f"n{x}"), "p_brand") for x in "ab")
    # all pairs of a brand, sizes that differ too; a brand's pairs are made in shares, so none is one task
    a = a.withColumn("_s", F.pmod("a", F.lit(L.SALTS)).cast("int"))
    b = b.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(L.SALTS - 1))))
    n = L.tasks(p)
    x = a.repartition(n, "p_brand", "_s").join(b.repartition(n, "p_brand", "_s"), ["p_brand", "_s"]).where("a < b")
    return x.select("a", "b", F.round(S.overlap(F.col("fa"), F.col("fb")), 6).alias("overlap"), F.round(S.numeric_similarity(F.col("na"), F.col("nb")), 6).alias("size_similarity"), F.round(S.jaccard(F.col("fa"), F.col("fb")), 6).alias("jaccard"))


@query(f"""
SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), {QV_SQL}), 6) AS similarity FROM embeddings ORDER BY similarity DESC, vec_id LIMIT 20""")
def cosine_topk(t: Tables):
    return V.dense_topk(t.embeddings, QV, 20)


_PROTO = """p0 AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i),
p AS (SELECT label, list(x ORDER BY i) AS proto FROM p0 GROUP BY label)"""


@query(f"""
WITH {_PROTO},
x AS (SELECT e.vec_id, p.label, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), p.proto) AS s FROM embeddings e, p),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) AS rank FROM x WHERE s >= 0.42)
SELECT vec_id, label, round(s, 6) AS similarity, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 4""")
def prototype_labels(t: Tables):
    return V.classify(t.embeddings, V.prototypes(t.embeddings))


@query(f"""
WITH e AS (SELECT vec_id, label, list_cosine_similarity(CAST(embedding AS DOUBLE[]), {QV_SQL}) AS c FROM embeddings)
SELECT vec_id, round(0.58::DOUBLE * (1 - exp(-label / 3.0::DOUBLE)) + 0.34::DOUBLE * greatest(0, c) + 0.08::DOUBLE * (label % 2), 6) AS score FROM e ORDER BY score DESC, vec_id LIMIT 50""")
def neural_fused(t: Tables):
    q = F.array(*[F.lit(x) for x in QV])
    s = V.neural_fused(S.saturating(F.col("label").cast("double")), S.cosine(F.col("embedding").cast("array<double>"), q), (F.col("label") % 2).cast("double"))
    return t.embeddings.select("vec_id", F.round(s, 6).alias("score")).orderBy(F.desc("score"), "vec_id").limit(50)


@query("""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n FROM e)
SELECT vec_id, round(n, 6) AS norm, round(v[1] / n, 6) AS first, round(v[64] / n, 6) AS last FROM n""")
def vector_normalize(t: Tables):
    v = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    u = v.select("vec_id", S.norm(F.col("v")).alias("n"), S.l2_normalize(F.col("v")).alias("u"))
    return u.select("vec_id", F.round("n", 6).alias("norm"), F.round(F.col("u")[0], 6).alias("first"), F.round(F.col("u")[63], 6).alias("last"))


@query()
def deterministic_vector(t: Tables):
    return t.benchmark.select("item_id", V.deterministic(64)("text").alias("embedding"))


@query()
def vector_codec_round_trip(t: Tables):
    return t.embeddings.select("vec_id", "embedding", V.encode_f32("embedding").alias("b")).select("vec_id", F.length("b").alias("n_bytes"), (V.decode_f32("b") == F.col("embedding")).alias("same"))


@query("""
WITH m AS (SELECT conv_id * 1000 + turn AS id, sha256(text) AS digest, turn FROM conversations),
i AS (SELECT id, CASE WHEN turn % 3 = 1 THEN 'old' ELSE digest END AS digest FROM m WHERE turn % 3 < 2)
SELECT m.id, m.digest FROM m LEFT JOIN i ON m.id = i.id AND m.digest = i.digest WHERE i.id IS NULL""")
def changed_digest(t: Tables):
    m = t.messages().select(F.col("message").alias("id"), F.col("revision").alias("digest"), "position")
    index = m.where("position % 3 < 2").select("id", F.when(F.col("position") % 3 == 1, "old").otherwise(F.col("digest")).alias("digest"), F.lit("v1").alias("fingerprint"))
    return V.to_embed(m.select("id", "digest"), index, "v1")
