"""Conversation memory: observations, snapshots, topics, context."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import context, conversations as C, render, topics as T
from .registry import Tables, query


@query("SELECT user_id, event_id, event_type, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_observation(t: Tables):
    return C.latest(t.events.select("user_id", "event_id", "event_type", "ts"), ["user_id"], F.desc("ts"), F.desc("event_id"))


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE event_type IN ('click', 'view')) WHERE r = 1")
def latest_message_in_sources(t: Tables):
    e = C.in_sources(t.events.withColumn("source", F.col("event_type")), ["click", "view"])
    return C.latest(e, ["user_id", "event_type"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_type", "event_id", "value")


@query("""
WITH l AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r, count(*) OVER (PARTITION BY user_id) AS observations FROM events)
SELECT user_id, event_id, ts, observations FROM l WHERE r = 1 ORDER BY ts DESC, user_id LIMIT 50""")
def list_conversations(t: Tables):
    e = t.events
    n = e.groupBy("user_id").agg(F.max_by(F.struct("event_id", "ts"), F.struct("ts", "event_id")).alias("h"), F.count("*").alias("observations"))
    return n.select("user_id", "h.event_id", "h.ts", "observations").orderBy(F.desc("ts"), "user_id").limit(50)


@query("""
WITH h AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS c FROM events GROUP BY user_id)
SELECT e.user_id AS conversation, e.event_id AS message, CAST(row_number() OVER (PARTITION BY e.user_id ORDER BY CASE WHEN event_id % 3 = 0 THEN event_id END NULLS LAST, ts, event_id) AS INTEGER) AS number
FROM events e JOIN h ON e.user_id = h.user_id AND e.event_type = h.c""")
def conversation_snapshot(t: Tables):
    e = t.events.select(F.col("user_id").alias("conversation"), F.col("event_type").alias("commit"), F.col("ts").alias("committed_at"), F.col("event_id").alias("seq"), F.col("event_id").alias("message"), F.col("ts").alias("created_at"), F.when(F.col("event_id") % 3 == 0, F.col("event_id")).alias("active_position"))
    return C.snapshot(e.select("conversation", "commit", "committed_at", "seq"), e.select("conversation", "commit", "message", "created_at", "active_position")).select("conversation", "message", "number")


@query("""
WITH l AS (SELECT user_id, arg_max(event_id, (ts, event_id)) AS m FROM events GROUP BY user_id)
SELECT e.user_id, e.event_id, e.event_id = l.m AS current FROM events e JOIN l ON e.user_id = l.user_id WHERE e.value > 50""")
def historical_vs_current(t: Tables):
    e = t.events
    head = e.groupBy(F.col("user_id").alias("message")).agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("revision"))
    hits = e.where("value > 50").select(F.col("user_id").alias("message"), F.col("event_id").alias("revision"))
    cur = C.current_only(hits, head).withColumn("current", F.lit(True))
    return hits.join(cur, ["message", "revision"], "left").select(F.col("message").alias("user_id"), F.col("revision").alias("event_id"), F.coalesce("current", F.lit(False)).alias("current"))


@query("SELECT event_id, event_type AS role, created_at FROM (SELECT event_id, event_type, CASE WHEN event_id % 11 = 0 THEN NULL ELSE ts END AS created_at FROM events) WHERE event_type = 'purchase' AND (created_at IS NULL OR created_at >= TIMESTAMP '2024-01-10') AND (created_at IS NULL OR created_at <= TIMESTAMP '2024-01-20')")
def role_time_filter(t: Tables):
    import datetime as dt

    m = t.events.select("event_id", F.col("event_type").alias("role"), F.when(F.col("event_id") % 11 != 0, F.col("ts")).alias("created_at"))
    return C.filtered(m, "purchase", dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 20))


@query("SELECT conv_id, turn, role FROM conversations")
def optional_filter(t: Tables):
    return C.filtered(t.conversations.withColumn("created_at", F.lit(None).cast("timestamp"))).select("conv_id", "turn", "role")


@query("SELECT o_orderkey, o_orderstatus, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = o_orderstatus) AS receipts FROM orders")
def ledger(t: Tables):
    c = t.orders.select(F.col("o_orderkey").alias("ref"), F.col("o_orderstatus").alias("commit"))
    r = t.lineitem.select(F.col("l_orderkey").alias("ref"), F.col("l_linestatus").alias("commit"))
    return C.ledger(c, r).select(F.col("ref").alias("o_orderkey"), F.col("commit").alias("o_orderstatus"), "receipts")


@query("SELECT event_type AS status, count(*) AS n FROM events GROUP BY 1")
def job_status_counts(t: Tables):
    return t.events.groupBy(F.col("event_type").alias("status")).agg(F.count("*").alias("n"))


@query("SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'conversations', count(*) FROM conversations UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'embeddings', count(*) FROM embeddings")
def index_counts(t: Tables):
    parts = [getattr(t, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n in ("documents", "conversations", "events", "embeddings")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("SELECT c_nationkey AS conversation, o_custkey AS parent, count(DISTINCT o_orderkey) AS children FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL HAVING children > 1")
def branch_points(t: Tables):
    e = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("conversation"), F.col("o_custkey").alias("parent"), F.col("o_orderkey").alias("child"))
    return C.branch_points(e)


@query("SELECT user_id AS id, ts AS updated_at, props AS payload, event_type = 'error' AS deleted FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, props DESC, (event_type = 'error') DESC) AS r FROM events) WHERE r = 1 ORDER BY ts DESC, user_id LIMIT 128")
def lww_merge(t: Tables):
    r = t.events.select(F.col("user_id").alias("id"), F.col("ts").alias("updated_at"), F.col("props").alias("payload"), (F.col("event_type") == "error").alias("deleted"))
    return C.merge_records(r, 128)


@query("SELECT id, updated_at FROM (SELECT user_id AS id, ts AS updated_at, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, props DESC) AS r FROM events) WHERE r = 1 AND event_type <> 'error'")
def visible_records(t: Tables):
    r = t.events.select(F.col("user_id").alias("id"), F.col("ts").alias("updated_at"), F.col("props").alias("payload"), (F.col("event_type") == "error").alias("deleted"))
    return C.merge_records(r, 1 << 30).where("not deleted").select("id", "updated_at")


@query("SELECT o_custkey, arg_min(o_totalprice, o_orderkey) AS first, arg_max(o_totalprice, o_orderkey) AS last FROM (SELECT * FROM orders WHERE o_orderstatus <> 'F') GROUP BY 1")
def first_last_seen(t: Tables):
    o = t.orders.withColumn("v", F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice")))
    return C.first_last(o, "o_custkey", "v", "o_orderkey")


@query("""
WITH m AS (SELECT conv_id, turn FROM conversations),
p AS (SELECT conv_id, 0 AS path, turn, turn AS position FROM m WHERE turn % 3 <> 2 UNION ALL SELECT conv_id, 1, turn, turn + 1 FROM m WHERE turn % 2 = 0),
f AS (SELECT conv_id, turn, arg_min(position, path) AS active_position, min(path) AS path FROM p GROUP BY ALL)
SELECT m.conv_id AS conversation, m.turn AS node, active_position, coalesce(f.path = 0, false) AS active, coalesce(f.path > 0, false) AS alternate FROM m LEFT JOIN f ON m.conv_id = f.conv_id AND m.turn = f.turn""")
def active_flags(t: Tables):
    m = t.conversations.select(F.col("conv_id").alias("conversation"), F.col("turn").alias("node"))
    a = m.where("node % 3 <> 2").select("conversation", F.lit(0).alias("path"), "node", F.col("node").alias("position"))
    b = m.where("node % 2 = 0").select("conversation", F.lit(1).alias("path"), "node", (F.col("node") + 1).alias("position"))
    return C.active_flags(m, a.unionByName(b)).select("conversation", "node", "active_position", "active", "alternate")


# Topics of a message are its words of nine letters or more.
_WORD = "[a-z]{9,}"
_MENTIONS = f"""c AS (SELECT conv_id * 1000 + turn AS message, conv_id, turn, text FROM conversations),
w AS (SELECT message, unnest(regexp_extract_all(text, '{_WORD}')) AS topic FROM c),
n AS (SELECT message, topic, 0.68::DOUBLE + 0.1::DOUBLE * least(5, count(*)) AS weight FROM w GROUP BY ALL),
df AS (SELECT topic, count(*) AS df FROM n GROUP BY topic)"""
_TOP = lambda k: f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY message ORDER BY weight DESC, topic) AS r FROM n) WHERE r <= {k})"
_ASSOC = f"""pr AS (SELECT a.topic AS l, b.topic AS r, 0.75::DOUBLE * sqrt(a.weight * b.weight) AS c, 'm' || a.message AS ev FROM {_TOP(36)} a JOIN {_TOP(36)} b ON a.message = b.message AND a.topic < b.topic
  UNION ALL SELECT least(a.topic, b.topic), greatest(a.topic, b.topic), 1.5::DOUBLE * sqrt(a.weight * b.weight), 'r' || c.message FROM c JOIN {_TOP(18)} a ON a.message = c.message JOIN {_TOP(18)} b ON b.message = c.message - 1 WHERE c.turn > 0 AND a.topic <> b.topic),
ag AS (SELECT l, r, sum(c) AS raw, count(DISTINCT ev) AS support FROM pr GROUP BY l, r),
asso AS (SELECT l AS "left", r AS "right", round(raw, 6) AS weighted_support, support, round(1 - exp(-(raw / sqrt(dl.df * dr.df)) / 3), 6) AS score FROM ag JOIN df dl ON dl.topic = l JOIN df dr ON dr.topic = r)"""


def _mentions(t: Tables):
    m = t.messages().select("message", F.explode(F.regexp_extract_all("content", F.lit(_WORD), F.lit(0))).alias("topic"))
    m = m.groupBy("message", "topic").agg((0.68 + 0.1 * F.least(F.lit(5), F.count("*"))).alias("weight"))
    return m.withColumn("graph", F.col("message")).withColumn("context", F.col("message"))


def _frequencies(m):
    return m.groupBy("topic").agg(F.count("*").alias("df"))


@query(f"WITH {_MENTIONS} SELECT message, topic, round(weight, 6) AS weight FROM n")
def topic_mentions(t: Tables):
    return _mentions(t).select("message", "topic", F.round("weight", 6).alias("weight"))


@query("""
WITH r AS (SELECT user_id % 7 AS topic, event_id % 5 AS graph, value, event_type FROM events)
SELECT topic, graph, max(value) AS weight, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS facets FROM r GROUP BY ALL""")
def topic_merge(t: Tables):
    m = t.events.select((F.col("user_id") % 7).alias("topic"), (F.col("event_id") % 5).alias("graph"), F.lit(0).alias("node"), F.lit(0).alias("context"), F.lit("x").alias("relation"), F.col("value").alias("weight"), F.array("event_type").alias("facets"), F.array("event_type").alias("aliases"))
    return T.merge_mentions(m).select("topic", "graph", "weight", F.array_join("facets", ",").alias("facets"))


@query("""
WITH tp AS (SELECT DISTINCT event_type AS topic FROM events UNION ALL SELECT 'none')
SELECT tp.topic, count(e.event_id) AS mentions, count(DISTINCT e.user_id) AS documents, min(e.ts) AS first_seen, max(e.ts) AS last_seen FROM tp LEFT JOIN events e ON e.event_type = tp.topic GROUP BY 1""")
def topic_stats(t: Tables):
    e = t.events.select(F.col("event_type").alias("topic"), F.col("user_id").alias("message"), F.col("ts").alias("seen_at"))
    topics = e.select("topic").distinct().unionByName(t.spark.sql("SELECT 'none' AS topic"))
    return T.statistics(topics, e)


@query(f"""WITH {_MENTIONS}, {_ASSOC} SELECT * FROM asso""")
def topic_associations(t: Tables):
    m = _mentions(t)
    return T.associations(m, t.replies(), _frequencies(m), propositions=False)


_SEEDS = "sd AS (SELECT topic, round(1.0::DOUBLE / log2(row_number() OVER (ORDER BY df DESC, topic) + 1), 6) AS strength FROM df QUALIFY row_number() OVER (ORDER BY df DESC, topic) <= 6)"
_HOP = """bo AS (SELECT "left" AS a, "right" AS b, score, support FROM asso UNION ALL SELECT "right", "left", score, support FROM asso),
hp AS (SELECT b AS topic, max(round(strength * score, 6)) AS strength, arg_min(a, (-round(strength * score, 6), a)) AS via FROM bo JOIN sd ON sd.topic = a WHERE support >= 1 AND b NOT IN (SELECT topic FROM sd) GROUP BY b ORDER BY strength DESC, topic LIMIT 12)"""


def _seeds(m):
    from ..operators.rank import ranked

    return ranked(_frequencies(m), F.desc("df"), "topic", limit=6).select("topic", F.round(1 / F.log2(F.col("rank") + 1), 6).alias("strength"))


@query(f"WITH {_MENTIONS}, {_ASSOC}, {_SEEDS}, {_HOP} SELECT topic, strength, via FROM hp")
def related_topics(t: Tables):
    m = _mentions(t)
    return T.related(T.associations(m, t.replies(), _frequencies(m), propositions=False), _seeds(m))


@query(f"""WITH {_MENTIONS}, {_ASSOC}, {_SEEDS}, {_HOP},
q AS (SELECT topic, strength AS q, 1 AS d FROM sd UNION ALL SELECT topic, strength * 0.65::DOUBLE, 0 FROM hp)
SELECT message, round(1 - exp(-sum(q.q * n.weight) / 3), 6) AS score, count(*) AS topics, CAST(sum(d) AS BIGINT) AS direct FROM n JOIN q ON q.topic = n.topic GROUP BY message ORDER BY score DESC, message LIMIT 50""")
def topic_query_plan(t: Tables):
    m = _mentions(t)
    s = _seeds(m)
    return T.query_plan(m, s, T.related(T.associations(m, t.replies(), _frequencies(m), propositions=False), s)).drop("via")


@query("""
WITH h AS (SELECT conv_id, turn FROM conversations WHERE regexp_matches(text, 'anon')),
d AS (SELECT unnest([-2, -1, 0, 1, 2]) AS d)
SELECT c.conv_id AS conversation, c.turn AS position, CAST(min(abs(d.d)) AS INTEGER) AS priority FROM h, d JOIN conversations c ON c.conv_id = h.conv_id AND c.turn = h.turn + d.d GROUP BY ALL""")
def context_select(t: Tables):
    m = t.messages()
    hits = m.where(F.col("content").contains("anon")).select("conversation", "position")
    return context.select_window(m, hits).select("conversation", "position", "priority")


@query()
def context_pack(t: Tables):
    m = t.messages()
    hits = m.where(F.col("content").contains("anon")).select("conversation", "position")
    x = context.select_window(m, hits).withColumn("query", F.col("conversation")).select("query", "priority", F.col("position").cast("int").alias("position"), "message", "revision", "content")
    return context.pack(x, budget=600)


@query("""
WITH h AS (SELECT conv_id, turn, length(text) AS s FROM conversations), r AS (SELECT *, row_number() OVER (ORDER BY s DESC, conv_id, turn) AS rank FROM h)
SELECT conv_id, CAST(min(rank) AS BIGINT) AS best_rank, min(s) AS best_score, count(*) AS hits FROM r WHERE rank <= 60 GROUP BY conv_id""")
def hits_by_snapshot(t: Tables):
    from ..operators.rank import ranked

    c = t.conversations.select("conv_id", "turn", F.length("text").cast("long").alias("s"))
    r = ranked(c, F.desc("s"), "conv_id", "turn", limit=60)
    return r.groupBy("conv_id").agg(F.min("rank").cast("long").alias("best_rank"), F.min("s").alias("best_score"), F.count("*").alias("hits"))


@query("""
WITH m AS (SELECT conv_id, turn, least(strlen(text), 2048) AS b FROM conversations), s AS (SELECT *, sum(b) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM m)
SELECT conv_id, turn, CAST(b AS INTEGER) AS n_bytes, CAST(run AS BIGINT) AS running FROM s WHERE run <= 4096""")
def bounded_conversation(t: Tables):
    from pyspark.sql import Window as W

    x = t.conversations.select("conv_id", "turn", F.least(F.octet_length("text"), F.lit(2048)).alias("n_bytes"))
    return x.withColumn("running", F.sum("n_bytes").over(W.partitionBy("conv_id").orderBy("turn"))).where("running <= 4096")


@query("SELECT conv_id, turn, greatest(1, CAST(ceil(strlen(text) / 4.0) AS BIGINT)) AS tokens FROM conversations")
def token_estimate(t: Tables):
    return t.conversations.select("conv_id", "turn", X.token_estimate(F.col("text")).alias("tokens"))


@query("""
SELECT conv_id, turn, CASE role WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' ELSE 'System' END || ': ' || CASE WHEN turn % 2 = 0 THEN '```text' || chr(10) || text || chr(10) || '```' ELSE text END AS markdown FROM conversations""")
def message_markdown(t: Tables):
    b = F.array(F.struct(F.when(F.col("turn") % 2 == 0, "code").otherwise("text").alias("type"), F.col("text").alias("text"), F.when(F.col("turn") % 2 == 0, "text").alias("language"), F.lit(None).cast("string").alias("url")))
    return t.conversations.select("conv_id", "turn", F.concat(render.role(F.col("role")), F.lit(": "), render.blocks(b)).alias("markdown"))


@query()
def context_markdown(t: Tables):
    return render.bundle(context_pack(t), t.messages())
