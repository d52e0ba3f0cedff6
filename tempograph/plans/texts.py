"""Text functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids, text as X
from ..operators import textgraph
from .registry import Tables, query

_STOP = "[" + ", ".join(f"'{w}'" for w in X.STOP) + "]"
_BOUND = "[" + ", ".join(f"'{w}'" for w in X.BOUNDARY) + "]"
_q = lambda s: s.replace("'", "''")


@query(f"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}][\\p{{L}}\\p{{N}}_-]*') AS w FROM documents),
f AS (SELECT doc_id, list_filter(w, lambda x: length(x) >= 2 AND NOT list_contains({_STOP}, x)) AS f FROM w),
u AS (SELECT doc_id, unnest(f) AS k, generate_subscripts(f, 1) AS i FROM f),
g AS (SELECT doc_id, k, min(i) AS i FROM u GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM g)
SELECT d.doc_id, coalesce(string_agg(k, ' ' ORDER BY i), '') AS keywords FROM documents d LEFT JOIN (SELECT * FROM r WHERE r <= 24) r ON r.doc_id = d.doc_id GROUP BY d.doc_id""")
def keywords(t: Tables):
    return t.documents.select("doc_id", F.array_join(X.keywords(F.col("text")), " ").alias("keywords"))


@query(f"""
WITH w AS (SELECT conv_id, turn, array_to_string(list_transform(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}][\\p{{L}}\\p{{N}}_-]*'), lambda x: CASE WHEN length(x) < 3 OR list_contains({_BOUND}, x) THEN '|' ELSE x END), ' ') AS j FROM conversations),
s AS (SELECT conv_id, turn, list_filter(list_transform(string_split(j, '|'), lambda x: trim(x)), lambda x: x <> '') AS s FROM w),
u AS (SELECT conv_id, turn, unnest(s) AS seg, generate_subscripts(s, 1) AS i FROM s),
v AS (SELECT *, string_split(seg, ' ') AS x, len(string_split(seg, ' ')) AS n FROM u),
c AS (SELECT conv_id, turn, i, 1 AS j, 'keyword' AS kind, seg AS label, 0.68::DOUBLE AS weight FROM v WHERE n = 1 AND length(seg) >= 5
  UNION ALL SELECT conv_id, turn, i, 1, 'phrase', seg, round(1.04::DOUBLE + (n - 2) * 0.12::DOUBLE, 2) FROM v WHERE n BETWEEN 2 AND 4
  UNION ALL SELECT conv_id, turn, i, k, 'phrase', array_to_string(x[k:k + 3], ' '), 1.28::DOUBLE FROM (SELECT *, unnest(range(1, n - 2)) AS k FROM v WHERE n > 4)),
g AS (SELECT conv_id, turn, kind, label, weight, min((i, j)) AS o FROM c GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY o) AS r FROM g)
SELECT conv_id, turn, kind, label, weight, CAST(r AS INTEGER) AS n FROM r WHERE r <= 8""")
def phrase_candidates(t: Tables):
    x = t.conversations.select("conv_id", "turn", F.posexplode(X.phrase_candidates(F.col("text"))).alias("i", "p"))
    return x.select("conv_id", "turn", "p.kind", "p.label", "p.weight", (F.col("i") + 1).alias("n"))


def _act_sql(kind: str, any_: str, start: str) -> str:
    parts = []
    if any_:
        parts.append(f"regexp_matches(x, '{_q(X.word_match(any_))}')")
    if start:
        parts.append(f"regexp_matches(x, '{_q(X.starts_with(start))}')")
    if kind == "question":
        parts += ["ends_with(x, '?')", "ends_with(x, '？')"]
    return " OR ".join(parts)


_ACTS = "\nUNION ALL ".join(f"SELECT id, '{layer}' AS layer, '{kind}' AS kind, {conf}::DOUBLE AS confidence FROM d WHERE {_act_sql(kind, a, s)}" for kind, layer, conf, a, s in X.ACTS)
_SAID = "d AS (SELECT event_id AS id, CASE event_id % 8 WHEN 0 THEN 'please ' WHEN 1 THEN 'We should ' WHEN 2 THEN 'it is not ready but ' WHEN 3 THEN 'because ' WHEN 4 THEN 'I don''t want ' WHEN 5 THEN 'go with ' WHEN 6 THEN 'how about ' ELSE 'the ' END || event_type || CASE event_id % 5 WHEN 0 THEN ' must be fixed' WHEN 1 THEN ' is done?' WHEN 2 THEN ' might be merged' WHEN 3 THEN ' only' ELSE ' will go' END AS x FROM events)"


def _said(t: Tables):
    pick = lambda n, v: F.element_at(F.array(*map(F.lit, v)), (F.col("event_id") % n + 1).cast("int"))
    a = pick(8, ["please ", "We should ", "it is not ready but ", "because ", "I don't want ", "go with ", "how about ", "the "])
    b = pick(5, [" must be fixed", " is done?", " might be merged", " only", " will go"])
    return t.events.select(F.col("event_id").alias("id"), F.concat(a, "event_type", b).alias("x"))


@query(f"WITH {_SAID} {_ACTS}")
def speech_acts(t: Tables):
    return _said(t).select("id", F.explode(X.speech_acts(F.col("x"))).alias("a")).select("id", "a.layer", "a.kind", "a.confidence")


_MOD = " ".join(f"WHEN regexp_matches(x, '{_q(X.word_match(p))}') THEN '{k}'" for k, p in X.MODALITY)


@query(f"WITH {_SAID} SELECT id, CASE {_MOD} ELSE 'asserted' END AS modality, CASE WHEN regexp_matches(x, '{_q(X.word_match(X.NEGATIVE))}') THEN 'negative' ELSE 'positive' END AS polarity FROM d")
def modality_polarity(t: Tables):
    return _said(t).select("id", X.modality(F.col("x")).alias("modality"), X.polarity(F.col("x")).alias("polarity"))


@query()
def sentence_offsets(t: Tables):
    return t.documents.select("doc_id", F.explode(X.sentence_offsets("text")).alias("s")).select("doc_id", "s.*")


_ENT = "e AS (SELECT p_partkey AS id, 'See https://github.com/org-' || lower(replace(p_brand, '#', '')) || '/Repo' || p_size || '.git, @scope/pkg-' || p_size || ' and lib/util' || p_size || '/main.py or team/tool' || p_size || '.' AS x FROM part)"


@query(f"""WITH {_ENT} SELECT id, regexp_replace(regexp_extract(x, 'https?://[^\\s<>"]+'), '[.,;:!?)\\]}}'']+$', '') AS url,
lower(regexp_replace(regexp_extract(regexp_replace(regexp_extract(x, 'https?://[^\\s<>"]+'), '[.,;:!?)\\]}}'']+$', ''), '^https?://(?:www\\.)?github\\.com/([A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+)', 1), '\\.git$', '')) AS repository,
regexp_extract(x, '(^|[^A-Za-z0-9_/@.-])(@[a-z0-9_-]+/[a-z0-9._-]*[a-z0-9_-])', 2) AS package, regexp_extract(x, '(^|[^A-Za-z0-9_/@.:-])((?:[A-Za-z0-9_-]+/)+[A-Za-z0-9_-]+\\.[a-z0-9]{{1,8}})', 2) AS path FROM e""")
def entity_extract(t: Tables):
    b = F.lower(F.replace("p_brand", F.lit("#"), F.lit("")))
    n = F.col("p_size").cast("string")
    x = t.part.select(F.col("p_partkey").alias("id"), F.concat(F.lit("See https://github.com/org-"), b, F.lit("/Repo"), n, F.lit(".git, @scope/pkg-"), n, F.lit(" and lib/util"), n, F.lit("/main.py or team/tool"), n, F.lit(".")).alias("x"))
    c = F.col("x")
    return x.select("id", X.urls(c)[0].alias("url"), X.repository_of(X.urls(c)[0]).alias("repository"), X.scoped_packages(c)[0].alias("package"), X.file_paths(c)[0].alias("path"))


@query()
def alias_match(t: Tables):
    m = X.alias_matcher({"article": ["the", "of the"], "verb": ["is"]})
    return t.conversations.select("conv_id", "turn", F.explode(m("text")).alias("m")).select("conv_id", "turn", "m.*")


@query()
def snippets(t: Tables):
    return t.documents.where(F.lower("text").contains("anon")).select("doc_id", X.snippet(["anon", "the"])("text").alias("snippet"))


@query()
def truncate_tokens(t: Tables):
    return t.documents.select("doc_id", X.truncated(64)("text").alias("text"))


@query("""SELECT conv_id, turn, CASE WHEN length(x) > 160 THEN substring(x, 1, 159) || '…' ELSE x END AS label FROM (SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS x FROM conversations)""")
def compact_labels(t: Tables):
    return t.conversations.select("conv_id", "turn", X.compact_label(F.col("text")).alias("label"))


@query("""SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\p{N}@/._-]+', ' ', 'g'), '\\s+', ' ', 'g')) AS key FROM documents""")
def normalized_topics(t: Tables):
    return t.documents.select("doc_id", X.normalize_topic(F.col("text")).alias("key"))


@query("""
WITH a AS (SELECT *, sha256('["repo","' || p_brand || '","' || p_name || '"]') AS logical FROM part)
SELECT p_partkey, logical, sha256('["' || logical || '","' || p_type || '"]') AS revision, 'p-' || substring(sha256('p' || chr(0) || p_name), 1, 24) AS source_key, substring(logical, 1, 2) || '/' || substring(logical, 3, 2) || '/' || logical AS shard FROM a""")
def topological_id(t: Tables):
    p = t.part.withColumn("logical", ids.logical_id(F.lit("repo"), F.col("p_brand"), F.col("p_name")))
    return p.select("p_partkey", "logical", ids.revision_id(F.col("logical"), F.col("p_type")).alias("revision"), ids.source_key(F.lit("p"), F.col("p_name")).alias("source_key"), ids.shard_path(F.col("logical")).alias("shard"))


@query()
def canonical_id(t: Tables):
    return t.events.select("event_id", ids.canonical_id("props").alias("id"))


@query("""SELECT event_id, make_timestamp(CAST((CASE WHEN event_id % 2 = 0 THEN 1700000000 + event_id ELSE 1700000000 + event_id END) AS BIGINT) * 1000000) AS t FROM events""")
def epoch_normalize(t: Tables):
    raw = F.when(F.col("event_id") % 2 == 0, 1700000000 + F.col("event_id")).otherwise((1700000000 + F.col("event_id")) * 1000)
    return t.events.select("event_id", X.epoch_normalize(raw.cast("string")).cast("timestamp_ntz").alias("t"))


@query("""
WITH d AS (SELECT doc_id, strlen(text) AS n FROM documents WHERE strlen(text) > 0)
SELECT doc_id, i AS start_byte, least(n, i + 16384) AS end_byte FROM (SELECT doc_id, n, unnest(range(0, greatest(1, n - 1024), 15360)) AS i FROM d)""")
def byte_chunks(t: Tables):
    size, lap = 16384, 1024
    d = t.documents.select("doc_id", F.octet_length("text").cast("long").alias("n")).where("n > 0")
    at = F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.col("n") - lap - 1), F.lit(size - lap).cast("long"))
    return d.select("doc_id", "n", F.explode(at).alias("start_byte")).select("doc_id", "start_byte", F.least(F.col("n"), F.col("start_byte") + size).alias("end_byte"))


@query()
def text_graph_nodes(t: Tables):
    return textgraph.nodes(textgraph.graphs(t.messages()))


@query()
def text_graph_project(t: Tables):
    return textgraph.project(t.messages(), "work")
