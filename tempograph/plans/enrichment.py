"""Documents, enrichment, indexed search, chat search end to end, typed contents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import similarity as S, text as X
from ..operators import context, conversations as C, documents as D, fts, lineage as L, rank, topics as T
from ..sources import content
from . import history
from .registry import SQL, Tables, query

_FOLD = r"regexp_extract_all(strip_accents(lower({})), '[\p{{L}}\p{{N}}]+')"


@query("""
SELECT sha256(text) AS revision, arg_min(text, doc_id) AS content, min(doc_id) AS first_seq, max(doc_id) AS last_seq, arg_max(lang, doc_id) AS path FROM documents GROUP BY 1""")
def revision_documents(t: Tables):
    return D.revision_documents(t.documents.select(F.sha2("text", 256).alias("revision"), F.col("text").alias("content"), F.col("doc_id").alias("seq"), F.col("lang").alias("path")))


@query("""
WITH p AS (SELECT l_orderkey AS c, string_agg(l_returnflag || '/' || l_partkey, chr(10) ORDER BY l_linenumber, l_returnflag || '/' || l_partkey) AS t FROM lineitem GROUP BY 1),
s AS (SELECT l_orderkey AS c, string_agg(p_name, chr(10) ORDER BY l_linenumber, p_name) AS t FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1)
SELECT o_orderkey AS "commit", o_orderpriority AS message, concat_ws(chr(10), p.t, s.t) AS content FROM orders LEFT JOIN p ON p.c = o_orderkey LEFT JOIN s ON s.c = o_orderkey
WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity = 50)""")
def commit_documents(t: Tables):
    li = t.lineitem.select(F.col("l_orderkey").alias("commit"), F.col("l_linenumber").alias("seq"), F.concat_ws("/", "l_returnflag", "l_partkey").alias("path"), "l_partkey", "l_quantity")
    names = li.join(t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("name")), "l_partkey").select("commit", "seq", "name")
    commits = t.orders.select(F.col("o_orderkey").alias("commit"), F.col("o_orderpriority").alias("message"))
    return D.commit_documents(commits, li.select("commit", "seq", "path"), names, li.where("l_quantity = 50"))


@query("""
SELECT p_partkey AS revision, l_returnflag || l_linenumber AS path, coalesce(l_orderkey, p_partkey) AS "commit", o_orderdate AS committed_at
FROM part LEFT JOIN (SELECT * FROM lineitem WHERE l_quantity > 49) ON l_partkey = p_partkey LEFT JOIN orders ON o_orderkey = coalesce(l_orderkey, p_partkey)""")
def coalesced_commits(t: Tables):
    r = t.part.select(F.col("p_partkey").alias("revision"), F.col("p_partkey").alias("last_commit"))
    l = t.lineitem.where("l_quantity > 49").select(F.col("l_partkey").alias("revision"), F.col("l_orderkey").alias("commit"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("path"))
    c = t.orders.select(F.col("o_orderkey").alias("commit"), F.col("o_orderdate").alias("committed_at"))
    return D.committed(r, l, c).select("revision", "path", "commit", "committed_at")


@query(f"""
WITH tr AS ({SQL['exact_transitions']}), r AS (SELECT sha256(text) AS revision, count(*) AS seen FROM documents GROUP BY 1)
SELECT tr.seq, tr.logical, tr.kind, r.revision, r.seen FROM tr JOIN r ON r.revision = coalesce(tr.revision, tr.prior)""")
def coalesced_revision(t: Tables):
    r = t.documents.groupBy(F.sha2("text", 256).alias("revision")).agg(F.count("*").alias("seen"))
    return D.changed_revisions(history.exact_transitions(t), r).select("seq", "logical", "kind", "revision", "seen")


@query("""
SELECT o.o_orderkey AS "commit", l.l_linenumber AS message, c.c_name AS conversation, o.o_orderdate AS committed_at
FROM lineitem l JOIN (SELECT DISTINCT l_orderkey, l_suppkey, l_returnflag FROM lineitem WHERE l_linestatus = 'O') k ON k.l_orderkey = l.l_orderkey AND k.l_suppkey = l.l_suppkey AND k.l_returnflag = l.l_returnflag
JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey""")
def three_way_observations(t: Tables):
    keys = ["l_orderkey", "l_suppkey", "l_returnflag"]
    k = t.lineitem.where("l_linestatus = 'O'").select(*keys).distinct()
    x = t.lineitem.join(k, keys).join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate"), "l_orderkey")
    x = x.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey")
    return x.select(F.col("l_orderkey").alias("commit"), F.col("l_linenumber").alias("message"), F.col("c_name").alias("conversation"), F.col("o_orderdate").alias("committed_at"))


@query("""
WITH o AS (SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS parent FROM orders),
ch AS (SELECT DISTINCT o_orderkey AS c, parent, l_returnflag AS path FROM o JOIN lineitem ON l_orderkey = o_orderkey)
SELECT ch.c AS "commit", ch.parent, ch.path AS new_path, l.l_partkey AS symbol, s.s_acctbal AS weight
FROM ch JOIN lineitem l ON l.l_orderkey = ch.parent AND l.l_returnflag = ch.path LEFT JOIN supplier s ON s.s_suppkey = l.l_partkey""")
def previous_symbols(t: Tables):
    from pyspark.sql import Window as W

    o = t.orders.select("o_orderkey", F.lag("o_orderkey").over(W.partitionBy("o_custkey").orderBy("o_orderkey")).alias("parent"))
    li = t.lineitem.select(F.col("l_orderkey").alias("commit"), F.col("l_returnflag").alias("path"), F.col("l_partkey").alias("symbol"))
    ch = o.withColumnRenamed("o_orderkey", "commit").join(li, "commit").select("commit", "parent", F.col("path").alias("old_path"), F.col("path").alias("new_path")).distinct()
    x = D.previous_symbols(ch, li, t.supplier.select(F.col("s_suppkey").alias("symbol"), F.col("s_acctbal").alias("weight")))
    return x.select("commit", "parent", "new_path", "symbol", "weight")


@query("""
WITH p AS (SELECT c_nationkey AS kind, c_mktsegment AS name, max(c_custkey) AS previous FROM customer GROUP BY 1, 2),
c AS (SELECT s_nationkey AS kind, CASE WHEN s_acctbal < 0 THEN 'HOUSEHOLD' ELSE 'MACHINERY' END AS name, max(s_suppkey) AS current FROM supplier GROUP BY 1, 2)
SELECT kind, name, previous, current, CASE WHEN previous IS NULL THEN 'added' WHEN current IS NULL THEN 'removed' WHEN previous = current THEN 'unchanged' ELSE 'modified' END AS state FROM p FULL JOIN c USING (kind, name)""")
def identity_match(t: Tables):
    p = t.customer.groupBy(F.col("c_nationkey").alias("kind"), F.col("c_mktsegment").alias("name")).agg(F.max("c_custkey").alias("revision"))
    c = t.supplier.groupBy(F.col("s_nationkey").alias("kind"), F.when(F.col("s_acctbal") < 0, "HOUSEHOLD").otherwise("MACHINERY").alias("name")).agg(F.max("s_suppkey").alias("revision"))
    return D.identity_match(p, c, ["kind", "name"])


_NEAR = "round(abs(a.confidence - b.confidence), 6) < 0.05"


@query(f"""WITH {history._PAIRS},
alt AS (SELECT a.block, a.from_id, a.to_id, string_agg(b.from_id || '>' || b.to_id, ',' ORDER BY b.from_id, b.to_id) AS alternatives FROM res a JOIN res b ON a.block = b.block AND {_NEAR}
  AND ((a.from_id = b.from_id AND a.to_id <> b.to_id) OR (a.to_id = b.to_id AND a.from_id <> b.from_id)) WHERE a.status = 'candidate' GROUP BY ALL)
SELECT * FROM alt""")
def lineage_alternatives(t: Tables):
    p, c, r = history._resolved(t)
    return L.group_alternatives(r, p, c, ["block"]).select("block", "from_id", "to_id", F.array_join("alternatives", ",").alias("alternatives"))


@query(f"""WITH {history._PAIRS}, ex AS (SELECT block, from_id, to_id, kind FROM m WHERE kind = 'split')
SELECT block, from_id, to_id, kind, confidence FROM m WHERE from_id <> to_id AND NOT EXISTS (SELECT 1 FROM ex WHERE ex.block = m.block AND ex.from_id = m.from_id AND ex.to_id = m.to_id AND ex.kind = m.kind)
UNION ALL SELECT block, from_id, to_id, 'candidate', confidence FROM res WHERE status = 'candidate'""")
def persisted_lineage(t: Tables):
    p, c, r = history._resolved(t)
    m = L.match(r, ["block"])
    keys = ["block", "from_id", "to_id", "kind"]
    have = m.where("kind = 'split'").select(*keys)
    fresh, candidates = L.to_persist(m, L.expand(r, p, c, ["block"]), have, r.limit(0).select("block", "from_id", "to_id"), ["block"])
    return fresh.select(*keys, "confidence").unionByName(candidates.select("block", "from_id", "to_id", F.lit("candidate").alias("kind"), "confidence"))


@query("SELECT count(*) AS replies FROM (SELECT DISTINCT conv_id * 1000 + turn, conv_id * 1000 + turn - 1 FROM conversations WHERE turn > 0)")
def distinct_replies(t: Tables):
    return t.replies().select("from_message", "to_message").distinct().agg(F.count("*").alias("replies"))


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_mktsegment, c_name DESC, c_custkey LIMIT 40")
def locale_order(t: Tables):
    return t.customer.orderBy(D.in_locale(F.col("c_mktsegment")), D.in_locale(F.col("c_name")).desc(), "c_custkey").limit(40).select("c_custkey", "c_name")


@query(f"""WITH a AS ({fts.bm25_sql('documents', 'doc_id', 'text', ['anon', 'que'], 300, 'lang')}) SELECT doc_id, lang, score FROM a WHERE lang = 'fr' ORDER BY score, doc_id LIMIT 10""")
def overfetch_postfilter(t: Tables):
    x = fts.bm25(t.documents, "doc_id", F.col("text"), ["anon", "que"], limit=None, keep=["lang"])
    return D.overfetched(x, F.col("lang") == "fr", 10, order=["score", "doc_id"]).select("doc_id", "lang", "score")


_WHEN = "CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.000Z') WHEN 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 2 THEN '2024-02-30T00:00:00.000Z' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END"


@query(f"SELECT event_id, {_WHEN} AS said, event_id % 4 = 0 AS strict FROM events")
def strict_timestamps(t: Tables):
    m = F.col("event_id") % 4
    said = F.when(m == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'.000Z'")).when(m == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(m == 2, "2024-02-30T00:00:00.000Z").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return t.events.select("event_id", said.alias("said")).withColumn("strict", D.strict_timestamp(F.col("said")))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN -1 ELSE CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS INTEGER) END AS k FROM events""")
def tolerant_parse(t: Tables):
    raw = F.when(F.col("event_id") % 3 == 0, F.substring("props", 1, 4)).otherwise(F.col("props"))
    x = t.events.select("event_id", D.parsed_or(raw, "k int", F.struct(F.lit(-1).alias("k"))).alias("p"))
    return x.select("event_id", F.coalesce("p.k", F.lit(-1)).alias("k"))


@query("""
SELECT user_id AS receipt, min(event_id) AS first_import FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) GROUP BY 1""")
def receipt_dedupe(t: Tables):
    e = t.events.groupBy(F.col("user_id").alias("receipt")).agg(F.min("event_id").alias("first_import"))
    return D.new_receipts(e, t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("receipt")))


@query("""
SELECT l_shipmode AS operation, min(v) AS min, round(avg(v), 6) AS mean, max(v) FILTER (WHERE r = ceil(0.5 * n)) AS p50, max(v) FILTER (WHERE r = ceil(0.95 * n)) AS p95, max(v) AS max
FROM (SELECT l_returnflag || l_linestatus AS l_shipmode, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag || l_linestatus ORDER BY l_extendedprice) AS r, count(*) OVER (PARTITION BY l_returnflag || l_linestatus) AS n FROM lineitem) GROUP BY 1""")
def latency_summary(t: Tables):
    return D.latency_summary(t.lineitem.withColumn("operation", F.concat("l_returnflag", "l_linestatus")), "operation", "l_extendedprice")


@query("""
WITH v AS (SELECT CASE WHEN label < 5 THEN 'fp-a' ELSE 'fp-b' END AS fingerprint FROM embeddings), t AS (SELECT 'fp-a' AS fingerprint FROM benchmark),
m AS (SELECT * FROM (VALUES ('fp-a', 2), ('fp-b', 3), ('fp-c', 1)) x(fingerprint, created_at))
SELECT m.fingerprint, m.created_at, (SELECT count(*) FROM v WHERE v.fingerprint = m.fingerprint) AS message_vectors, (SELECT count(*) FROM t WHERE t.fingerprint = m.fingerprint) AS topic_vectors FROM m""")
def model_status(t: Tables):
    models = t.spark.createDataFrame([("fp-a", 2), ("fp-b", 3), ("fp-c", 1)], "fingerprint string, created_at int")
    return D.model_status(models, t.embeddings.select(F.when(F.col("label") < 5, "fp-a").otherwise("fp-b").alias("fingerprint")), t.benchmark.select(F.lit("fp-a").alias("fingerprint")))


@query("""
SELECT conv_id AS conversation, 'c' || conv_id AS title, count(*) AS messages, count(*) FILTER (WHERE turn > 0) AS edges, count(*) FILTER (WHERE role <> 'system') AS active_path_messages FROM conversations GROUP BY conv_id""")
def import_summary(t: Tables):
    m = t.messages()
    c = t.conversations.select(F.col("conv_id").alias("conversation"), F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("title")).distinct()
    return D.import_summary(c, m, t.replies(), m.where("role <> 'system'"))


@query(f"""
WITH h AS ({fts.bm25_sql('documents', 'doc_id', 'text', ['anon', 'erthe'], 20)}), d AS (SELECT doc_id, sha256(text) AS revision FROM documents),
tr AS ({SQL['exact_transitions']}),
l AS (SELECT sha256(text) AS revision, string_agg(doc_id || '@' || lang, ',' ORDER BY doc_id) AS locations FROM documents GROUP BY 1),
k AS (SELECT coalesce(revision, prior) AS revision, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, count(*) AS n FROM tr GROUP BY 1)
SELECT h.doc_id, h.score, d.revision, l.locations, coalesce(k.kinds, '') AS kinds, coalesce(k.n, 0) AS transitions FROM h JOIN d ON d.doc_id = h.doc_id LEFT JOIN l ON l.revision = d.revision LEFT JOIN k ON k.revision = d.revision""")
def retrieve_enriched(t: Tables):
    d = t.documents.withColumn("revision", F.sha2("text", 256))
    h = fts.bm25(d, "doc_id", F.col("text"), ["anon", "erthe"], 20, keep=["revision"])
    x = D.enriched(h, d.select("revision", F.col("doc_id").alias("seq"), F.col("lang").alias("path")), history.exact_transitions(t))
    where = F.array_join(F.transform("locations", lambda s: F.concat_ws("@", s["seq"], s["path"])), ",")
    return x.select("doc_id", "score", "revision", where.alias("locations"), F.coalesce(F.array_join("kinds", ","), F.lit("")).alias("kinds"), "transitions")


# Search over postings with fields and their weights, phrases among the terms.
_INDEXED = ["anon", "of the", "MACHINERY", "fr"]


@query(f"""
WITH a AS (SELECT doc_id, {_FOLD.format('text')} AS t, {_FOLD.format('lang')} AS l FROM documents),
b AS (SELECT doc_id, len(t) + len(l) AS len, len(list_filter(t, lambda x: x = 'anon')) + 4.0 * len(list_filter(l, lambda x: x = 'anon')) AS f0, len(list_filter(range(1, len(t)), lambda i: t[i] = 'of' AND t[i + 1] = 'the'))::DOUBLE AS f1,
  len(list_filter(t, lambda x: x = 'machinery'))::DOUBLE AS f2, len(list_filter(t, lambda x: x = 'fr')) + 4.0 * len(list_filter(l, lambda x: x = 'fr')) AS f3 FROM a),
s AS (SELECT count(*) AS n, avg(len) AS av, {', '.join(f'count(*) FILTER (WHERE f{i} > 0) AS d{i}' for i in range(4))} FROM b)
SELECT doc_id, round(-({' + '.join(f'greatest(1e-6, ln((n - d{i} + 0.5) / (d{i} + 0.5))) * (f{i} * 2.2) / (f{i} + 1.2 * (1 - 0.75 + 0.75 * len / av))' for i in range(4))}), 6) AS score, CAST({' + '.join(f'(f{i} > 0)::INT' for i in range(4))} AS INTEGER) AS hits
FROM b, s WHERE {' OR '.join(f'f{i} > 0' for i in range(4))} ORDER BY score, doc_id LIMIT 30""")
def fts_indexed_fields(t: Tables):
    from ..work import Work

    fields, work = {"text": F.col("text"), "lang": F.col("lang")}, Work(t.spark, "postings")
    path = work.cut(fts.postings(t.documents, "doc_id", fields))
    return fts.search_postings(path, work.cut(fts.indexed_lengths(path, t.documents, "doc_id")), "doc_id", _INDEXED, 30, {"lang": 4.0})


@query(fts.bm25_sql("conversations", "conv_id * 1000 + turn AS message", "text", ["elle", "éèré", "für"], 20).replace("ORDER BY score, conv_id * 1000 + turn AS message", "ORDER BY score, message").replace("SELECT conv_id * 1000 + turn AS message, round", "SELECT message, round").replace("SELECT conv_id * 1000 + turn AS message, len(t)", "SELECT message, len(t)"))
def fts_accent_folded(t: Tables):
    """Terms with accents find words without, and the other way round."""
    return fts.bm25(t.messages(), "message", F.col("content"), ["elle", "éèré", "für"])


_SPLIT = r"regexp_extract_all(lower(text), '[a-z]{9,}')"
_SENT = """c AS (SELECT conv_id * 1000 + turn AS message, conv_id, turn, string_split(lower(text), '.') AS s FROM conversations),
se AS (SELECT message, unnest(s) AS s, generate_subscripts(s, 1) AS i FROM c),
w AS (SELECT message, message || ':' || i AS context, unnest(regexp_extract_all(s, '[a-z]{9,}')) AS topic FROM se),
n AS (SELECT message, context, topic, 0.68::DOUBLE + 0.1::DOUBLE * least(5, count(*)) AS weight FROM w GROUP BY ALL),
df AS (SELECT topic, count(DISTINCT message) AS df FROM n GROUP BY topic)"""
_BEST = lambda g, k: f"(SELECT * FROM (SELECT {g}, topic, max(weight) AS weight, row_number() OVER (PARTITION BY {g} ORDER BY max(weight) DESC, topic) AS r FROM n GROUP BY {g}, topic) WHERE r <= {k})"
_FULL = f"""pr AS (SELECT a.topic AS l, b.topic AS r, 0.75::DOUBLE * sqrt(a.weight * b.weight) AS c, 'message:' || a.message AS ev FROM {_BEST('message', 36)} a JOIN {_BEST('message', 36)} b ON a.message = b.message AND a.topic < b.topic
  UNION ALL SELECT a.topic, b.topic, 4.0::DOUBLE * sqrt(a.weight * b.weight), 'proposition:' || a.context FROM {_BEST('context', 24)} a JOIN {_BEST('context', 24)} b ON a.context = b.context AND a.topic < b.topic
  UNION ALL SELECT least(a.topic, b.topic), greatest(a.topic, b.topic), 1.5::DOUBLE * sqrt(a.weight * b.weight), 'reply:' || c.message || ':' || (c.message - 1) FROM c JOIN {_BEST('message', 18)} a ON a.message = c.message JOIN {_BEST('message', 18)} b ON b.message = c.message - 1 WHERE c.turn > 0 AND a.topic <> b.topic),
e AS (SELECT l, r, ev, sum(c) AS s FROM pr GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY l, r ORDER BY round(s, 6) DESC, ev) AS rn FROM e),
ag AS (SELECT l, r, sum(s) AS raw, count(*) AS support, string_agg(ev, ',' ORDER BY rn) FILTER (WHERE rn <= 16) AS evidence FROM k GROUP BY l, r),
asso AS (SELECT l AS "left", r AS "right", round(raw, 6) AS weighted_support, support, round(1 - exp(-(raw / sqrt(dl.df * dr.df)) / 3), 6) AS score, evidence FROM ag JOIN df dl ON dl.topic = l JOIN df dr ON dr.topic = r)"""


def _sentence_mentions(t: Tables):
    s = t.messages().select("message", F.posexplode(F.split(F.lower("content"), r"\.")).alias("i", "s"))
    s = s.select("message", F.concat_ws(":", F.col("message").cast("string"), (F.col("i") + 1).cast("string")).alias("context"), F.explode(F.regexp_extract_all("s", F.lit("[a-z]{9,}"), F.lit(0))).alias("topic"))
    s = s.groupBy("message", "context", "topic").agg((0.68 + 0.1 * F.least(F.lit(5), F.count("*"))).alias("weight"))
    return s.withColumn("graph", F.col("message"))


@query(f"WITH {_SENT}, {_FULL} SELECT * FROM asso")
def topic_associations_full(t: Tables):
    """All three legs, with the sixteen strongest pieces of evidence of each pair."""
    m = _sentence_mentions(t)
    f = m.groupBy("topic").agg(F.count_distinct("message").alias("df"))
    return T.associations(m, t.replies(), f, evidence=16).select("left", "right", "weighted_support", "support", "score", F.array_join("evidence", ",").alias("evidence"))


_TOPIC_LEG = f"""{_SENT},
sd AS (SELECT topic, round(1.0::DOUBLE / log2(row_number() OVER (ORDER BY df DESC, topic) + 1), 6) AS strength FROM df QUALIFY row_number() OVER (ORDER BY df DESC, topic) <= 6),
bm AS (SELECT message, topic, max(weight) AS weight FROM n GROUP BY ALL),
tp AS (SELECT message, round(1 - exp(-sum(strength * weight) / 3), 6) AS score, string_agg(bm.topic, ',' ORDER BY round(strength * weight, 6) DESC, bm.topic) AS via FROM bm JOIN sd ON sd.topic = bm.topic GROUP BY message)"""


@query(f"""WITH {_TOPIC_LEG},
fm AS (SELECT conv_id * 1000 + turn AS message, role, text, turn FROM conversations),
lx AS (SELECT message, score, row_number() OVER (ORDER BY score, message) AS r FROM ({fts.bm25_sql('fm', 'message', 'text', ['anon', 'tion'], None, 'role')}) WHERE role <> 'system' ORDER BY score, message LIMIT 60),
tl AS (SELECT message, tp.score, via, row_number() OVER (ORDER BY tp.score DESC, message) AS r FROM tp JOIN fm USING (message) WHERE role <> 'system' ORDER BY tp.score DESC, message LIMIT 60)
SELECT message, role, CAST(lx.r AS INTEGER) AS lexical_rank, lx.score AS bm25, CAST(tl.r AS INTEGER) AS topic_rank, tl.score AS topic_score, via,
  round(coalesce(1.0::DOUBLE / (60 + lx.r), 0) + coalesce(0.85::DOUBLE / (60 + tl.r) + 0.01::DOUBLE * tl.score, 0), 6) AS fused
FROM lx FULL JOIN tl USING (message) JOIN fm USING (message) ORDER BY fused DESC, bm25 NULLS LAST, topic_score DESC NULLS LAST, message LIMIT 20""")
def chat_search(t: Tables):
    """Lexical and topic legs, a role filter before their limits, the topics found by, fused order, limit."""
    m = t.messages().select("message", "role", "content")
    keep = m.where("role <> 'system'").select("message")
    mentions = _sentence_mentions(t)
    df = mentions.groupBy("topic").agg(F.count_distinct("message").alias("df"))
    seeds = rank.ranked(df, F.desc("df"), "topic", limit=6).select("topic", F.round(S.rank_strength(F.lit(False), F.col("rank")), 6).alias("strength"))
    plan = T.query_plan(mentions, seeds, seeds.limit(0), limit=None)
    lex = rank.ranked(fts.bm25(m, "message", F.col("content"), ["anon", "tion"], None).join(keep, "message", "left_semi"), "score", "message", limit=60)
    top = rank.ranked(plan.join(keep, "message", "left_semi"), F.desc("score"), "message", limit=60)
    x = rank.fused_search(lex, top, "message").join(top.select("message", F.array_join("via", ",").alias("via")), "message", "left").join(m.select("message", "role"), "message")
    x = x.select("message", "role", "lexical_rank", "bm25", "topic_rank", "topic_score", "via", "fused")
    return x.orderBy(F.desc("fused"), F.col("bm25").asc_nulls_last(), F.col("topic_score").desc_nulls_last(), "message").limit(20)


@query("""
WITH m AS (SELECT conv_id, turn, text FROM conversations), h AS (SELECT conv_id, turn FROM m WHERE regexp_matches(text, 'anon')),
ed AS (SELECT conv_id, turn AS a, CASE WHEN turn % 3 = 2 THEN turn - 2 ELSE turn - 1 END AS b FROM m WHERE turn > 0),
act AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM m WHERE turn % 3 <> 1),
p AS (SELECT conv_id, turn, 0 AS p FROM h
  UNION ALL SELECT a.conv_id, b.turn, abs(a.i - b.i) FROM h JOIN act a ON a.conv_id = h.conv_id AND a.turn = h.turn JOIN act b ON b.conv_id = a.conv_id AND abs(a.i - b.i) <= 2
  UNION ALL SELECT h.conv_id, ed.b, 1 FROM h JOIN ed ON ed.conv_id = h.conv_id AND ed.a = h.turn WHERE h.turn % 3 = 1
  UNION ALL SELECT h.conv_id, ed.a, 1 FROM h JOIN ed ON ed.conv_id = h.conv_id AND ed.b = h.turn WHERE h.turn % 3 = 1),
q AS (SELECT conv_id, turn, min(p) AS p FROM p GROUP BY ALL),
z AS (SELECT * FROM q UNION ALL SELECT q.conv_id, ed.b, p + 1 FROM q JOIN ed ON ed.conv_id = q.conv_id AND ed.a = q.turn UNION ALL SELECT q.conv_id, ed.a, p + 1 FROM q JOIN ed ON ed.conv_id = q.conv_id AND ed.b = q.turn)
SELECT conv_id AS conversation, conv_id * 1000 + turn AS message, CAST(min(p) AS INTEGER) AS priority FROM z GROUP BY ALL""")
def context_selection(t: Tables):
    """Hits, their neighbours on the active path, those off it by their edges, and one step into branches."""
    m = t.messages()
    node = lambda c: F.col("conversation") * 1000 + c
    turn = F.col("position")
    e = m.where("position > 0").select("conversation", F.col("message").alias("from"), node(F.when(turn % 3 == 2, turn - 2).otherwise(turn - 1)).alias("to"))
    active = m.where("position % 3 <> 1").select("conversation", "message", F.col("position").alias("active_position"))
    hits = m.where(F.col("content").contains("anon")).select("conversation", "message")
    return context.select_messages(m.select("conversation", "message"), hits, active, e, radius=2, branches=True)


_PUB = "least(strlen(text), 2048)"


@query(f"""
WITH m AS (SELECT conv_id, turn, {_PUB} AS b, sum({_PUB}) OVER (PARTITION BY conv_id ORDER BY turn) AS run, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
k AS (SELECT *, count(*) FILTER (WHERE run <= 4096 AND r <= 5) OVER (PARTITION BY conv_id) AS kept FROM m)
SELECT conv_id AS conversation, conv_id * 1000 + turn AS message, CAST(b AS INTEGER) AS n_bytes, kept < n AS truncated FROM k WHERE run <= 4096 AND r <= 5""")
def public_conversation(t: Tables):
    from ..operators import render

    m, _ = render.public_conversation(t.messages(), t.replies(), max_messages=5, message_bytes=2048, total_bytes=4096)
    return m.select("conversation", "message", "n_bytes", "truncated")


@query("""
WITH o AS (SELECT user_id AS conversation, event_type AS "commit", max(ts) AS seen FROM events WHERE ts <= TIMESTAMP '2024-01-15' GROUP BY ALL),
h AS (SELECT conversation, arg_max("commit", row(seen, "commit")) AS c FROM o GROUP BY 1)
SELECT e.user_id AS conversation, e.event_id AS message, CAST(row_number() OVER (PARTITION BY e.user_id ORDER BY e.ts, e.event_id) AS INTEGER) AS number,
  lag(e.event_id) OVER (PARTITION BY e.user_id ORDER BY e.event_id) AS reply_to FROM events e JOIN h ON h.conversation = e.user_id AND h.c = e.event_type""")
def snapshot_at(t: Tables):
    """The state of each conversation at a time: messages in order, with the edge to what each replies to."""
    import datetime as dt

    from pyspark.sql import Window as W

    e = t.events.select(F.col("user_id").alias("conversation"), F.col("event_type").alias("commit"), F.col("ts").alias("created_at"), F.col("event_id").alias("message"), F.lit(None).cast("int").alias("active_position"))
    obs = e.groupBy("conversation", "commit").agg(F.max(F.when(F.col("created_at") <= F.lit(dt.datetime(2024, 1, 15)), F.col("created_at"))).alias("committed_at")).where("committed_at is not null").withColumn("seq", F.col("commit"))
    edges = e.select("conversation", "commit", F.col("message").alias("from"), F.lag("message").over(W.partitionBy("conversation", "commit").orderBy("message")).alias("to")).where("to is not null")
    m, ed = C.snapshot_graph(obs, e, edges, until=dt.datetime(2024, 1, 15))
    return m.join(ed.select("conversation", F.col("from").alias("message"), F.col("to").alias("reply_to")), ["conversation", "message"], "left").select("conversation", "message", "number", "reply_to")


_CONTENT = """CASE turn % 4 WHEN 0 THEN '"' || 'plain ' || turn || '"' WHEN 1 THEN '{"content_type":"text","parts":["a' || turn || '",null]}' WHEN 2 THEN '{"content_type":"code","text":"x = ' || turn || '"}' ELSE '[{"asset_pointer":"file-' || turn || '","width":3,"height":4}]' END"""


@query("""
WITH c AS (SELECT conv_id, turn FROM conversations),
b AS (SELECT conv_id, turn, 1 AS n, CASE turn % 4 WHEN 0 THEN 'text' WHEN 1 THEN 'text' WHEN 2 THEN 'code' ELSE 'image' END AS type, CASE turn % 4 WHEN 0 THEN 'plain ' || turn WHEN 1 THEN 'a' || turn WHEN 2 THEN 'x = ' || turn END AS text, CASE turn % 4 WHEN 3 THEN 'file-' || turn END AS asset_pointer FROM c
  UNION ALL SELECT conv_id, turn, 2, 'provider', NULL, NULL FROM c WHERE turn % 4 = 1)
SELECT conv_id, turn, n, type, text, asset_pointer FROM b""")
def content_blocks(t: Tables):
    raw = F.expr(_CONTENT.replace("||", "||").replace("turn ||", "CAST(turn AS STRING) ||").replace("|| turn", "|| CAST(turn AS STRING)"))
    x = t.conversations.select("conv_id", "turn", F.posexplode(content.blocks(raw)).alias("i", "b"))
    return x.select("conv_id", "turn", (F.col("i") + 1).alias("n"), "b.type", "b.text", "b.asset_pointer")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey IS NOT NULL AND l_returnflag <> 'N' THEN 'resolved' WHEN l_linestatus = 'F' THEN 'candidate' ELSE 'unresolved' END AS resolution FROM lineitem""")
def usage_resolution(t: Tables):
    from ..sources import analysis

    target = F.when(F.col("l_returnflag") != "N", F.col("l_suppkey").cast("string"))
    alias = F.when(F.col("l_linestatus") == "F", F.lit("a"))
    return t.lineitem.select("l_orderkey", "l_linenumber", analysis.usage_resolution(target, alias).alias("resolution"))


@query(r"""
WITH k AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'project' WHEN 1 THEN 'url' ELSE 'other' END AS kind, event_type FROM events)
SELECT event_id, round((CASE kind WHEN 'project' THEN 1.7::DOUBLE WHEN 'url' THEN 1.1::DOUBLE ELSE 1.2::DOUBLE END) * (CASE event_type WHEN 'purchase' THEN 1.35::DOUBLE WHEN 'error' THEN 1.25::DOUBLE ELSE 1.0::DOUBLE END), 6) AS weight FROM k""")
def mention_weights(t: Tables):
    m = F.col("event_id") % 3
    kind = F.when(m == 0, "project").when(m == 1, "url").otherwise("other")
    facets = F.when(F.col("event_type") == "purchase", F.array(F.lit("question"), F.lit("decision"))).when(F.col("event_type") == "error", F.array(F.lit("rejection"))).otherwise(F.array().cast("array<string>"))
    return t.events.select("event_id", F.round(T.entity_weight(kind) * T.facet_boost(facets), 6).alias("weight"))


@query()
def text_graph_topics(t: Tables):
    """Topics of every message's text graph: references and phrases of its propositions."""
    from ..operators import textgraph
    from ..work import Work

    g = Work(t.spark, "graphs").cut(textgraph.graphs(t.messages()))  # read many times, made once
    return T.from_text_graph(textgraph.nodes(g), textgraph.edges(g)).select("graph", "topic", "kind", "label", "relation", "weight", "facets")
