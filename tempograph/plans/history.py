"""Code history: transitions, fuzzy lineage, traces, joins against facts."""

from __future__ import annotations

import math

from pyspark.sql import Window as W, functions as F

from ..functions import text as X
from ..operators import graph, lineage as L, recovery
from .registry import Tables, query

#: Rows that a task of a join by file takes on average.
TASK_ROWS = 250_000

_OBS = "o AS (SELECT doc_id AS seq, source AS logical, sha256(text) AS revision, lang AS path FROM documents)"
_DEL = "d AS (SELECT doc_id AS seq, lang AS path FROM documents WHERE doc_id % 97 = 5)"
_EVENTS = """ev AS (SELECT d.seq, d.path, o.logical, arg_max(o.revision, o.seq) AS revision FROM (SELECT DISTINCT * FROM d) d JOIN o ON o.path = d.path AND o.seq <= d.seq GROUP BY ALL)"""


def _deleted(t: Tables):
    return t.documents.where("doc_id % 97 = 5").select(F.col("doc_id").alias("seq"), F.col("lang").alias("path"))


@query(f"WITH {_OBS}, {_DEL}, {_EVENTS} SELECT seq, path, logical, revision FROM ev")
def deletion_events(t: Tables):
    return L.deletion_events(t.observed(), _deleted(t))


@query(f"""
WITH {_OBS}, {_DEL}, {_EVENTS},
f AS (SELECT *, row_number() OVER (PARTITION BY logical, revision ORDER BY seq) = 1 AS fst FROM o),
p AS (SELECT *, last_value(CASE WHEN fst THEN revision END IGNORE NULLS) OVER (PARTITION BY logical ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM f),
g AS (SELECT logical, revision AS prior, min(seq) AS gone FROM ev GROUP BY ALL),
q AS (SELECT p.*, g.gone, pp.path AS prior_path FROM p LEFT JOIN g ON g.logical = p.logical AND g.prior = p.prior
  ASOF LEFT JOIN o pp ON pp.logical = p.logical AND pp.revision = p.prior AND p.seq > pp.seq)
SELECT seq, logical, path, revision, prior, CASE WHEN prior IS NULL THEN 'introduced' WHEN gone < seq THEN 'resurrected' WHEN prior <> revision THEN 'modified' WHEN prior_path <> path THEN 'moved' ELSE 'unchanged' END AS kind FROM q
UNION ALL SELECT seq, logical, path, NULL, revision, 'deleted' FROM ev""")
def exact_transitions(t: Tables):
    return L.exact_transitions(t.observed(), _deleted(t))


@query(f"""
WITH {_OBS},
f AS (SELECT *, row_number() OVER (PARTITION BY logical, revision ORDER BY seq) = 1 AS fst FROM o),
p AS (SELECT *, last_value(CASE WHEN fst THEN revision END IGNORE NULLS) OVER (PARTITION BY logical ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM f),
q AS (SELECT p.*, pp.path AS prior_path FROM p ASOF LEFT JOIN o pp ON pp.logical = p.logical AND pp.revision = p.prior AND p.seq > pp.seq)
SELECT q.seq, logical AS name, CASE WHEN prior IS NULL THEN 'introduced' WHEN prior <> revision THEN 'modified' WHEN prior_path <> path THEN 'moved' ELSE 'unchanged' END AS kind, e.ts AS committed_at
FROM q LEFT JOIN events e ON e.event_id = q.seq WHERE lower(logical) LIKE 'src1%'""")
def symbol_history(t: Tables):
    tr = L.exact_transitions(t.observed()).drop("prior")
    symbols = t.documents.select(F.col("source").alias("logical"), F.col("source").alias("name")).distinct()
    commits = t.events.select(F.col("event_id").alias("seq"), F.col("ts").alias("committed_at"))
    return L.symbol_history(tr, commits, symbols, "src1").select("seq", "name", "kind", "committed_at")


def _sides(t: Tables):
    """Symbols from part, in blocks of brand: the even keys against the odd ones, which together are the whole table."""
    p = t.part.select(F.col("p_brand").alias("block"), F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.concat(F.lit("["), F.col("p_type"), F.lit("]")).alias("signature"), F.sha2(F.concat_ws("|", "p_name", "p_type"), 256).alias("structural_hash"), F.col("p_type").alias("shape_hash"), X.lineage_tokens(F.col("p_type")).alias("features"), F.col("p_size").alias("node_count"), (F.col("p_size") % 7).alias("depth"), (F.col("p_size") % 3).alias("arity"), F.concat_ws(" ", "p_name", "p_type").alias("content"), F.split("p_type", " ").alias("references"), F.array(F.col("p_brand")).alias("changed_paths"))
    odd = F.col("id").cast("long") % 2 != 0
    return p.where(~odd), p.where(odd)


def _resolved(t: Tables):
    """Groups of equal symbols of both sides, and their resolved pairs. A resolved pair is one of single symbols: what repeats has another pair of the same confidence."""
    p, c = map(L.groups, _sides(t))
    return p, c, L.resolve(L.score_groups(p, c, ["block"]), ["block"])


_TOK = lambda x: f"list_distinct(list_filter(regexp_split_to_array(lower({x}), '[^a-z0-9_!?*-]+'), lambda z: z <> ''))"
_JAC = lambda a, b: f"CASE WHEN len(list_distinct(list_concat({a}, {b}))) > 0 THEN len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) ELSE 1 END"
_NUM = lambda a, b: f"greatest(0, least(1, 1 - abs({a} - {b})::DOUBLE / greatest(1, {a}, {b})))"
_PAIRS = f"""
s AS (SELECT p_brand AS block, CAST(p_partkey AS VARCHAR) AS id, p_partkey AS k, p_name AS name, p_type AS kind, {_TOK('p_name')} AS nt, {_TOK("p_name || ' ' || p_name || ' ' || p_type")} AS tt,
  {_TOK("'[' || p_type || ']'")} AS st, {_TOK('p_type')} AS f, p_size AS n FROM part),
e AS (SELECT a.block, a.id AS from_id, b.id AS to_id, a.name AS from_name, b.name AS to_name,
  CASE WHEN a.name = b.name THEN 1 ELSE {_JAC('a.nt', 'b.nt')} END AS e_name, (a.kind = b.kind)::INT::DOUBLE AS e_kind,
  CASE WHEN a.name = b.name AND a.kind = b.kind THEN 1 ELSE round((a.kind = b.kind)::INT * 0.45::DOUBLE + ({_JAC('a.f', 'b.f')}) * 0.3::DOUBLE + {_NUM('a.n', 'b.n')} * 0.1::DOUBLE + {_NUM('a.n % 7', 'b.n % 7')} * 0.1::DOUBLE + {_NUM('a.n % 3', 'b.n % 3')} * 0.05::DOUBLE, 6) END AS e_structure,
  {_JAC('a.tt', 'b.tt')} AS e_token, CASE WHEN a.kind = b.kind THEN 1 ELSE {_JAC('a.st', 'b.st')} END AS e_signature, {_JAC('a.f', 'b.f')} AS e_references, 1.0::DOUBLE AS e_diff
  FROM s a JOIN s b ON a.block = b.block WHERE a.k % 2 = 0 AND b.k % 2 <> 0),
c AS (SELECT *, round((e_name * 0.22::DOUBLE + e_kind * 0.15::DOUBLE + e_structure * 0.28::DOUBLE + e_token * 0.12::DOUBLE + e_signature * 0.14::DOUBLE + e_references * 0.04::DOUBLE + e_diff * 0.05::DOUBLE) / 1.0::DOUBLE, 6) AS confidence FROM e),
pairs AS (SELECT * FROM c WHERE confidence >= 0.45),
res AS (SELECT p.*, CASE WHEN EXISTS (SELECT 1 FROM pairs q WHERE q.block = p.block AND ((q.from_id = p.from_id AND q.to_id <> p.to_id) OR (q.to_id = p.to_id AND q.from_id <> p.from_id)) AND round(abs(q.confidence - p.confidence), 6) < 0.05) THEN 'candidate' ELSE 'resolved' END AS status FROM pairs p),
m0 AS (SELECT *, count(*) OVER (PARTITION BY block, from_id) AS od, count(*) OVER (PARTITION BY block, to_id) AS idg FROM res WHERE status = 'resolved'),
m AS (SELECT *, CASE WHEN od > 1 AND idg > 1 THEN 'split-merge' WHEN od > 1 THEN 'split' WHEN idg > 1 THEN 'merge' WHEN from_name = to_name THEN 'modified' ELSE 'moved' END AS kind FROM m0)"""


@query(f"WITH {_PAIRS} SELECT block, from_id, to_id, confidence, round(e_structure, 6) AS structure, round(e_token, 6) AS token FROM pairs")
def fuzzy_score_pairs(t: Tables):
    return L.score_pairs(*_sides(t), ["block"]).select("block", "from_id", "to_id", "confidence", F.round("e_structure", 6).alias("structure"), F.round("e_token", 6).alias("token"))


@query(f"WITH {_PAIRS} SELECT block, from_id, to_id, confidence, status FROM res")
def fuzzy_ambiguity(t: Tables):
    p, c, r = _resolved(t)
    return L.expand(r, p, c, ["block"]).select("block", "from_id", "to_id", "confidence", "status")


@query(f"WITH {_PAIRS} SELECT block, from_id, to_id, kind FROM m")
def lineage_split_merge(t: Tables):
    return L.match(_resolved(t)[2], ["block"]).select("block", "from_id", "to_id", "kind")


@query(f"WITH {_PAIRS} SELECT s.block, s.id FROM s WHERE s.k % 2 = 0 AND NOT EXISTS (SELECT 1 FROM m WHERE m.block = s.block AND m.from_id = s.id)")
def lineage_unmatched(t: Tables):
    return L.unmatched(_sides(t)[0], L.match(_resolved(t)[2], ["block"]), ["block"], "from_id").select("block", "id")


def _edges(t: Tables):
    """References: region to nation to customer; the edge to a customer with a debt is dynamic."""
    n = t.nation.select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("source"), F.col("n_nationkey").alias("ordinal"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("target"), F.col("n_name").alias("target_name"), F.lit("resolved").alias("resolution"))
    c = t.customer.select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("source"), F.col("c_custkey").cast("int").alias("ordinal"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("target"), F.col("c_name").alias("target_name"), F.when(F.col("c_acctbal") < 0, "dynamic").otherwise("resolved").alias("resolution"))
    return n.unionByName(c)


_TRACE = """
e AS (SELECT 'r' || n_regionkey AS source, n_nationkey AS ordinal, 'n' || n_nationkey AS target, n_name AS name, 'resolved' AS resolution FROM nation
  UNION ALL SELECT 'n' || c_nationkey, CAST(c_custkey AS INTEGER), 'c' || c_custkey, c_name, CASE WHEN c_acctbal < 0 THEN 'dynamic' ELSE 'resolved' END FROM customer),
st AS (SELECT 'r' || r_regionkey AS id FROM region),
w AS (
  SELECT id AS start, id AS node, [id] AS nodes, []::INTEGER[] AS ord, 0 AS level, NULL::VARCHAR AS terminal FROM st
  UNION ALL
  SELECT w.start, e.target, list_append(w.nodes, e.target), list_append(w.ord, e.ordinal), w.level + 1,
    CASE WHEN e.name IN ('JAPAN', 'NATION_3') THEN 'sink' WHEN e.resolution <> 'resolved' THEN e.resolution WHEN list_contains(w.nodes, e.target) THEN 'cycle' END
  FROM w JOIN e ON e.source = w.node WHERE w.terminal IS NULL AND w.level < 4),
p AS (SELECT start, nodes, ord, level - 1 AS level, terminal FROM w WHERE terminal IS NOT NULL
  UNION ALL SELECT start, nodes, ord, level, CASE WHEN level >= 4 THEN 'max-depth' ELSE 'leaf' END FROM w WHERE terminal IS NULL AND (level >= 4 OR node NOT IN (SELECT source FROM e)))"""


@query(f"""WITH RECURSIVE {_TRACE}, q AS (SELECT *, row_number() OVER (ORDER BY level, start, ord) AS position FROM p)
SELECT CAST(position AS INTEGER) AS position, start, array_to_string(nodes, '>') AS path, terminal, CAST(level AS INTEGER) AS depth FROM q WHERE position <= 50""")
def trace_paths(t: Tables):
    starts = t.region.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"))
    x = graph.trace(_edges(t), starts, ["JAPAN", "NATION_3"], max_depth=4)
    return x.select("position", "start", F.array_join("nodes", ">").alias("path"), "terminal", "depth")


@query(f"WITH RECURSIVE {_TRACE} SELECT start, terminal, count(*) AS paths FROM p GROUP BY ALL")
def trace_terminals(t: Tables):
    starts = t.region.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"))
    return graph.trace(_edges(t), starts, ["JAPAN", "NATION_3"], max_depth=4, max_paths=None).groupBy("start", "terminal").agg(F.count("*").alias("paths"))


@query("""
WITH RECURSIVE e AS (SELECT conv_id * 1000 + turn AS child, conv_id * 1000 + turn - 1 AS parent FROM conversations WHERE turn > 0),
r AS (SELECT conv_id * 1000 + max(turn) AS root FROM conversations GROUP BY conv_id),
u AS (SELECT root, root AS node, 0 AS depth FROM r UNION ALL SELECT u.root, e.parent, u.depth + 1 FROM u JOIN e ON e.child = u.node)
SELECT root, node, CAST(min(depth) AS INTEGER) AS depth FROM u GROUP BY ALL""")
def ancestor_check(t: Tables):
    e = t.replies().select(F.col("from_message").alias("child"), F.col("to_message").alias("parent"))
    r = t.conversations.groupBy("conv_id").agg(F.max("turn").alias("t")).select((F.col("conv_id") * 1000 + F.col("t")).alias("root"))
    return graph.ancestors(e, r)


@query("SELECT conv_id AS conversation, conv_id * 1000 + turn AS node, CAST(turn AS INTEGER) AS position FROM conversations")
def active_path(t: Tables):
    n = t.conversations.select(F.col("conv_id").alias("conversation"), (F.col("conv_id") * 1000 + F.col("turn")).alias("node"), F.when(F.col("turn") > 0, F.col("conv_id") * 1000 + F.col("turn") - 1).alias("parent"))
    return graph.active_path(n, n.groupBy("conversation").agg(F.max("node").alias("node")))


@query("""
WITH m AS (SELECT conv_id, turn, role <> 'system' AS has FROM conversations)
SELECT a.conv_id AS conversation, a.conv_id * 1000 + a.turn AS node, a.conv_id * 1000 + max(b.turn) AS ancestor
FROM m a JOIN m b ON a.conv_id = b.conv_id AND b.turn < a.turn AND b.has WHERE a.has GROUP BY a.conv_id, a.turn""")
def nearest_message_ancestor(t: Tables):
    n = t.conversations.select(F.col("conv_id").alias("conversation"), (F.col("conv_id") * 1000 + F.col("turn")).alias("node"), F.when(F.col("turn") > 0, F.col("conv_id") * 1000 + F.col("turn") - 1).alias("parent"), (F.col("role") != "system").alias("has_message"))
    return graph.nearest_ancestor(n)


@query("SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')")
def gap_anti_join(t: Tables):
    return t.orders.select("o_orderkey", "o_custkey").join(t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


@query("SELECT DISTINCT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') OR c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)")
def in_or_in_semi(t: Tables):
    c = t.customer.select("c_custkey", "c_name", "c_nationkey")
    a = c.join(t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")
    b = c.join(t.supplier.where("s_acctbal < 0").select(F.col("s_nationkey").alias("c_nationkey")), "c_nationkey", "left_semi")
    return a.unionByName(b).select("c_custkey", "c_name").distinct()


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS has_checkpoint FROM customer")
def exists_flag(t: Tables):
    o = t.orders.select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("x", F.lit(True))
    return t.customer.select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", F.col("x").isNotNull().alias("has_checkpoint"))


@query("""
SELECT o.o_orderkey, (SELECT l.l_shipdate FROM lineitem l WHERE l.l_orderkey = o.o_orderkey ORDER BY l.l_linenumber, l.l_shipdate LIMIT 1) AS first_shipdate FROM orders o""")
def first_digest_subquery(t: Tables):
    f = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min_by("l_shipdate", F.struct("l_linenumber", "l_shipdate")).alias("first_shipdate"))
    return t.orders.select("o_orderkey").join(f, "o_orderkey", "left")


@query("""
WITH r AS (SELECT l_orderkey AS file, l_linenumber AS id, l_linenumber * 10 AS lo, l_linenumber * 10 + CAST(l_quantity AS INTEGER) AS hi FROM lineitem),
p AS (SELECT l_orderkey AS file, l_linenumber AS ref, l_linenumber * 10 + 5 AS at FROM lineitem)
SELECT p.file, p.ref, arg_min(r.id, (r.hi - r.lo) * 1000 + r.id) AS owner FROM p JOIN r ON p.file = r.file AND p.at BETWEEN r.lo AND r.hi GROUP BY p.file, p.ref""")
def range_enclosing_min(t: Tables):
    li = t.lineitem.select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("n"), F.col("l_quantity").cast("int").alias("q"))
    # a task's share has a fixed number of rows, so its sorts stay in the same memory however many there are
    li = li.repartition(max(t.spark.sparkContext.defaultParallelism, math.ceil(li.count() / TASK_ROWS)), "file")
    r = li.select("file", F.col("n").alias("id"), (F.col("n") * 10).alias("lo"), (F.col("n") * 10 + F.col("q")).alias("hi"))
    p = li.select("file", F.col("n").alias("ref"), (F.col("n") * 10 + 5).alias("at"))
    return p.join(r, "file").where("at between lo and hi").groupBy("file", "ref").agg(F.min_by("id", F.struct(F.col("hi") - F.col("lo"), "id")).alias("owner"))


_PATHS = """pt AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'vendor/' WHEN 1 THEN 'generated/' ELSE 'src/' END || replace(lower(p_brand), '#', '') || '/file' || p_partkey ||
  CASE p_partkey % 7 WHEN 0 THEN '.py' WHEN 1 THEN '.ts' WHEN 2 THEN '.clj' WHEN 3 THEN '.jsx' WHEN 4 THEN '.xyz' WHEN 5 THEN '.mjs' ELSE '.txt' END AS path, p_size * 300000 AS size FROM part)"""


def _paths(t: Tables):
    pick = lambda n, m, other: F.coalesce(*[F.when(F.col("p_partkey") % n == i, F.lit(v)) for i, v in m.items()], F.lit(other))
    path = F.concat(pick(6, {0: "vendor/", 1: "generated/"}, "src/"), F.replace(F.lower("p_brand"), F.lit("#"), F.lit("")), F.lit("/file"), F.col("p_partkey").cast("string"), pick(7, {0: ".py", 1: ".ts", 2: ".clj", 3: ".jsx", 4: ".xyz", 5: ".mjs"}, ".txt"))
    return t.part.select("p_partkey", path.alias("path"), (F.col("p_size") * 300000).alias("size"))


LANGUAGES = {"py": "python", "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "clj": "clojure", "cljc": "clojure", "bb": "clojure", "hal": "hal"}


def language(path):
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.coalesce(*[F.when(ext == e, n) for e, n in LANGUAGES.items()])


def skip_reason(path, size):
    p = F.lower(path)
    return F.when(p.rlike("(^|/)(?:vendor|node_modules|third_party)/"), "vendored").when(p.rlike("(^|/)(?:generated|dist|build)/"), "generated").when(language(path).isNull(), "unsupported-language").when(size > 10 * 1024 * 1024, "oversized")


@query(f"WITH {_PATHS} SELECT p_partkey, path, CASE regexp_extract(path, '[.]([a-z]+)$', 1) WHEN 'py' THEN 'python' WHEN 'ts' THEN 'typescript' WHEN 'clj' THEN 'clojure' WHEN 'jsx' THEN 'javascript' WHEN 'mjs' THEN 'javascript' END AS language, replace(regexp_replace(path, '[.][a-z]+$', ''), '/', '.') AS module, list_extract(string_split(path, '/'), -1) AS name FROM pt")
def language_by_ext(t: Tables):
    p = F.col("path")
    return _paths(t).select("p_partkey", "path", language(p).alias("language"), X.module_name(p).alias("module"), X.last_segment(p).alias("name"))


@query(f"""WITH {_PATHS} SELECT CASE WHEN path LIKE 'vendor/%' THEN 'vendored' WHEN path LIKE 'generated/%' THEN 'generated' WHEN regexp_matches(path, '[.](xyz|txt)$') THEN 'unsupported-language' WHEN size > 10485760 THEN 'oversized' END AS reason, count(*) AS n FROM pt GROUP BY 1 HAVING reason IS NOT NULL""")
def skip_reasons(t: Tables):
    return _paths(t).select(skip_reason(F.col("path"), F.col("size")).alias("reason")).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


@query("""
WITH k AS (SELECT l_orderkey, l_linenumber, l_quantity, l_suppkey FROM lineitem)
SELECT l_suppkey, l_quantity AS median_low FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity, l_orderkey, l_linenumber) AS r, count(*) OVER (PARTITION BY l_suppkey) AS c FROM k) WHERE r = ceil(0.95 * c)""")
def latency_percentile(t: Tables):
    by = W.partitionBy("l_suppkey")
    x = t.lineitem.select("l_suppkey", "l_quantity", F.row_number().over(by.orderBy("l_quantity", "l_orderkey", "l_linenumber")).alias("r"), F.count("*").over(by).alias("c"))
    return x.where(F.col("r") == F.ceil(F.lit(0.95) * F.col("c"))).select("l_suppkey", F.col("l_quantity").alias("median_low"))


@query("""
WITH rv AS (SELECT o_orderkey AS revision, o_custkey AS name, o_orderstatus AS c, o_orderkey AS seq FROM orders),
rf AS (SELECT o_orderkey + 1 AS id, o_custkey AS target, o_orderstatus AS c, o_orderpriority = '5-LOW' AS dyn FROM orders),
ex AS (SELECT name, c, max(revision) AS r FROM rv GROUP BY ALL), la AS (SELECT name, max(revision) AS r FROM rv GROUP BY ALL)
SELECT rf.id, CASE WHEN NOT dyn THEN coalesce(ex.r, la.r) END AS target FROM rf LEFT JOIN ex ON ex.name = rf.target AND ex.c = rf.c LEFT JOIN la ON la.name = rf.target""")
def resolve_reference_targets(t: Tables):
    o = t.orders
    rv = o.select(F.col("o_orderkey").alias("revision"), F.col("o_custkey").alias("name"), F.col("o_orderstatus").alias("commit"), F.col("o_orderkey").alias("seq"))
    rf = o.select((F.col("o_orderkey") + 1).alias("id"), F.col("o_custkey").alias("target_name"), F.col("o_orderstatus").alias("commit"), F.when(F.col("o_orderpriority") == "5-LOW", "dynamic").otherwise("resolved").alias("resolution"))
    return graph.resolve_targets(rf, rv).select("id", "target")


@query("""
SELECT p_partkey, p_name, CASE WHEN CAST(p_partkey AS VARCHAR) = 'x' THEN 0 WHEN p_name = 'y' THEN 1 WHEN starts_with(lower(p_name), 'part') THEN 2 ELSE 3 END AS tier
FROM part WHERE contains(lower(p_name), 'part') ORDER BY tier, p_name, CAST(p_partkey AS VARCHAR) LIMIT 20""")
def start_resolver(t: Tables):
    s = t.part.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), "p_partkey")
    return graph.resolve_starts(s, "part").select("p_partkey", F.col("name").alias("p_name"), "tier")


@query("""
SELECT 'customer' AS name, count(*) AS n FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)
UNION ALL SELECT 'lineitem', count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)""")
def integrity_counts(t: Tables):
    a = recovery.orphans(t.orders, t.customer, {"o_custkey": "c_custkey"}).agg(F.count("*").alias("n")).select(F.lit("customer").alias("name"), "n")
    b = recovery.duplicates(t.lineitem, ["l_orderkey", "l_linenumber"]).agg(F.count("*").alias("n")).select(F.lit("lineitem").alias("name"), "n")
    return a.unionByName(b)


@query("""
WITH r AS (SELECT c_custkey AS ref, max(o_orderkey) AS head FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1),
k AS (SELECT ref, CASE ref % 4 WHEN 0 THEN head WHEN 1 THEN head - 1 WHEN 2 THEN -1 END AS cp FROM r)
SELECT r.ref, head, cp AS checkpoint, CASE WHEN cp IS NULL THEN 'missing' WHEN NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = cp) THEN 'rewritten' WHEN cp = head THEN 'current' ELSE 'behind' END AS state FROM r JOIN k ON r.ref = k.ref""")
def recovery_inspection(t: Tables):
    refs = t.orders.groupBy(F.col("o_custkey").alias("ref")).agg(F.max("o_orderkey").alias("head")).join(t.customer.select(F.col("c_custkey").alias("ref")), "ref", "left_semi")
    m = F.col("ref") % 4
    cp = refs.select("ref", F.when(m == 0, F.col("head")).when(m == 1, F.col("head") - 1).when(m == 2, -1).alias("oid")).where("oid is not null")
    jobs = t.spark.createDataFrame([], "ref long, status string")
    return recovery.inspect(refs, cp, t.orders.select(F.col("o_orderkey").alias("oid")), jobs).select("ref", "head", "checkpoint", "state")


@query("""
SELECT DISTINCT l_partkey AS new_blob FROM lineitem WHERE l_returnflag = 'R' AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 25)""")
def repair_gaps(t: Tables):
    # keys are no blob ids: a prefix keeps the key 0 from being taken for the id of no blob
    blob = lambda c: F.concat(F.lit("p"), F.col(c).cast("string"))
    ch = t.lineitem.where("l_returnflag = 'R'").select(blob("l_partkey").alias("new_blob"), F.lit("100644").alias("new_mode"), F.lit("x").alias("new_path"))
    an = t.part.where("p_size < 25").select(blob("p_partkey").alias("blob_oid"), F.lit("v1").alias("fingerprint"))
    return recovery.gaps(ch, an, "v1").select(F.substring("new_blob", 2, 20).cast("long").alias("new_blob"))
