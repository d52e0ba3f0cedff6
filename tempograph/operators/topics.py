"""Topics: mentions, statistics, the association graph, one-hop expansion and query plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import similarity as S, text as X

SAME_PROPOSITION, SAME_MESSAGE, DIRECT_REPLY = (4.0, 24), (0.75, 36), (1.5, 18)


ENTITY_WEIGHTS = {"project": 1.7, "repository": 1.6, "package": 1.35, "path": 1.3, "entity": 1.2, "url": 1.1}
FACET_WEIGHTS = dict(question=1.05, rationale=1.08, status=1.1, correction=1.12, request=1.14, proposal=1.16, acceptance=1.2, rejection=1.25, constraint=1.3, decision=1.35)


def entity_weight(kind: Column) -> Column:
    """What a mention of an entity counts by its kind; unknown kinds count like any entity."""
    return F.coalesce(*[F.when(kind == k, F.lit(w)) for k, w in ENTITY_WEIGHTS.items()], F.lit(ENTITY_WEIGHTS["entity"]))


def facet_boost(facets: Column) -> Column:
    """The largest weight of the speech acts that a proposition is said in, 1 at least."""
    one = lambda f: F.coalesce(*[F.when(f == k, F.lit(w)) for k, w in FACET_WEIGHTS.items()], F.lit(1.0))
    return F.greatest(F.lit(1.0), F.coalesce(F.array_max(F.transform(facets, one)), F.lit(1.0)))


def merge_mentions(mentions: DataFrame) -> DataFrame:
    """Of equal (topic, graph, node, context, relation): the largest weight, unions of facets, aliases, anchors and supports as far as the columns are there, sorted."""
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    sets = [c for c in ("facets", "aliases", "anchors", "supports") if c in mentions.columns]
    same = [F.min(c).alias(c) for c in ("kind", "label") if c in mentions.columns]
    return mentions.groupBy("topic", "graph", "node", "context", "relation").agg(F.max("weight").alias("weight"), *same, *map(union, sets))


def from_text_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Topic mentions of text graphs: (topic, graph, node, context, relation, weight, kind, label, facets, aliases, anchors, supports).

    A proposition's references are topics, weighted by their kind, and so are the phrases of its text that name none of
    them; both times the boost of the speech acts that it is said in. References of no proposition are topics on their own.
    All are joins by graph and node, so a graph's size bounds none of it.
    """
    node = nodes.select("graph", F.col("id").alias("node"), "layer", "kind", "label", "anchors", F.coalesce("key", "label").alias("key"))
    props = node.where("layer = 'semantic' and kind = 'proposition'").select("graph", F.col("node").alias("context"), F.col("label").alias("said"), F.col("anchors").alias("said_at"))
    acts = edges.where(F.col("kind").endswith(":qualifies")).select("graph", F.col("from").alias("node"), F.col("to").alias("context"))
    acts = acts.join(node.where("layer in ('discourse', 'work')").select("graph", "node", F.col("kind").alias("act")), ["graph", "node"])
    acts = acts.groupBy("graph", "context").agg(F.array_sort(F.collect_set("act")).alias("facets"), F.array_sort(F.collect_set("node")).alias("acts"))
    props = props.join(acts, ["graph", "context"], "left").withColumn("facets", F.coalesce("facets", F.array().cast("array<string>"))).withColumn("acts", F.coalesce("acts", F.array().cast("array<string>")))
    about = edges.where("kind = 'semantic:about'").select("graph", F.col("from").alias("context"), F.col("to").alias("node")).distinct()
    refs = node.where("layer = 'reference'").withColumn("names", F.array_distinct(F.array("label", "key"))).withColumn("known", F.array(X.normalize_topic(F.col("label")), X.normalize_topic(F.col("key"))))
    tied = about.join(refs.drop("layer"), ["graph", "node"]).join(props, ["graph", "context"])
    topic = lambda kind, key: F.concat_ws(":", kind, X.normalize_topic(key))
    cols = ["topic", "graph", "node", "context", "relation", "weight", "kind", "label", "facets", "aliases", "anchors", "supports"]
    a = tied.select(topic(F.col("kind"), F.col("key")).alias("topic"), "graph", "node", "context", F.lit("reference").alias("relation"), F.round(entity_weight(F.col("kind")) * facet_boost(F.col("facets")), 6).alias("weight"), "kind", "label", "facets", F.col("names").alias("aliases"), "anchors", F.array_union(F.array("node", "context"), "acts").alias("supports"))
    named = tied.groupBy("graph", "context").agg(F.array_distinct(F.flatten(F.collect_list("known"))).alias("named"))
    p = props.join(named, ["graph", "context"], "left").withColumn("p", F.explode(X.phrase_candidates(F.col("said"))))
    p = p.withColumn("own", X.normalize_topic(F.col("p.label"))).where("not coalesce(array_contains(named, own), false)")
    p = p.select(topic(F.col("p.kind"), F.col("p.label")).alias("topic"), "graph", F.col("context").alias("node"), "context", F.lit("phrase").alias("relation"), F.round(F.col("p.weight") * facet_boost(F.col("facets")), 6).alias("weight"), "p.kind", "p.label", "facets", F.array("p.label").alias("aliases"), F.col("said_at").alias("anchors"), F.array_union(F.array("context"), "acts").alias("supports"))
    alone = refs.join(tied.select("graph", "node").distinct(), ["graph", "node"], "left_anti")
    alone = alone.select(topic(F.col("kind"), F.col("key")).alias("topic"), "graph", "node", F.col("node").alias("context"), F.lit("reference").alias("relation"), F.round(entity_weight(F.col("kind")), 6).alias("weight"), "kind", "label", F.array().cast("array<string>").alias("facets"), F.col("names").alias("aliases"), "anchors", F.array("node").alias("supports"))
    return merge_mentions(a.select(*cols).unionByName(p.select(*cols)).unionByName(alone.select(*cols)))


def top_topics(mentions: DataFrame, group: str, k: int) -> DataFrame:
    """The best weight of each topic in each group, the first k by (weight, topic). The limit comes before any pairs are made."""
    x = mentions.groupBy(group, "topic").agg(F.max("weight").alias("weight"))
    w = W.partitionBy(group).orderBy(F.desc("weight"), "topic")
    return x.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def _within(mentions: DataFrame, group: str, gain: float, k: int, relation: str) -> DataFrame:
    t = top_topics(mentions, group, k)
    r = t.select(group, F.col("topic").alias("right"), F.col("weight").alias("wr"))
    x = t.select(group, F.col("topic").alias("left"), F.col("weight").alias("wl")).join(r, group).where(F.col("left") < F.col("right"))
    return x.select("left", "right", (gain * F.sqrt(F.col("wl") * F.col("wr"))).alias("contribution"), F.concat_ws(":", F.lit(relation), F.col(group).cast("string")).alias("evidence"))


def associations(mentions: DataFrame, replies: DataFrame, frequencies: DataFrame, propositions: bool = True, evidence: int = 0) -> DataFrame:
    """(left, right, weighted_support, support, score): topics of the same proposition (context), message (graph) and direct replies (from_message, to_message). With ``evidence`` also that many of a pair's strongest pieces of evidence, in order."""
    parts = [_within(mentions, "graph", *SAME_MESSAGE, "message")]
    if propositions:
        parts.append(_within(mentions, "context", *SAME_PROPOSITION, "proposition"))
    gain, k = DIRECT_REPLY
    t = top_topics(mentions, "message", k)
    a = t.select(F.col("message").alias("from_message"), F.col("topic").alias("a"), F.col("weight").alias("wa"))
    b = t.select(F.col("message").alias("to_message"), F.col("topic").alias("b"), F.col("weight").alias("wb"))
    x = replies.select("from_message", "to_message").distinct().join(a, "from_message").join(b, "to_message").where("a <> b")
    parts.append(x.select(F.least("a", "b").alias("left"), F.greatest("a", "b").alias("right"), (gain * F.sqrt(F.col("wa") * F.col("wb"))).alias("contribution"), F.concat_ws(":", F.lit("reply"), F.col("from_message").cast("string"), F.col("to_message").cast("string")).alias("evidence")))
    x = parts[0]
    for p in parts[1:]:
        x = x.unionByName(p)
    # a reply's pair can come twice (a-b and b-a); its evidence is one
    x = x.groupBy("left", "right", "evidence").agg(F.sum("contribution").alias("s"))
    extra = []
    if evidence:  # the rank is a window, so no more than the best of a pair are gathered
        x = x.withColumn("_rn", F.row_number().over(W.partitionBy("left", "right").orderBy(F.desc(F.round("s", 6)), "evidence")))
        extra = [F.transform(F.array_sort(F.collect_list(F.when(F.col("_rn") <= evidence, F.struct("_rn", "evidence")))), lambda s: s["evidence"]).alias("evidence")]
    x = x.groupBy("left", "right").agg(F.sum("s").alias("raw"), F.count("*").alias("support"), *extra)
    f = frequencies.select("topic", F.greatest(F.lit(1), F.col("df")).alias("df"))
    x = x.join(f.select(F.col("topic").alias("left"), F.col("df").alias("dl")), "left").join(f.select(F.col("topic").alias("right"), F.col("df").alias("dr")), "right")
    return x.select("left", "right", F.round("raw", 6).alias("weighted_support"), F.col("support").cast("long").alias("support"), F.round(S.saturating(F.col("raw") / F.sqrt(F.col("dl") * F.col("dr"))), 6).alias("score"), *(["evidence"] if evidence else []))


def statistics(topics: DataFrame, mentions: DataFrame) -> DataFrame:
    """Mentions, documents, first and last time of every topic, those without a mention too."""
    m = mentions.groupBy("topic").agg(F.count("*").alias("mentions"), F.count_distinct("message").alias("documents"), F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"))
    return topics.join(m, "topic", "left").withColumn("mentions", F.coalesce("mentions", F.lit(0))).withColumn("documents", F.coalesce("documents", F.lit(0)))


def related(edges: DataFrame, seeds: DataFrame, min_support: int = 1, limit: int = 12) -> DataFrame:
    """One hop over the undirected association graph from seeds (topic, strength): the best strength * score for each topic that is no seed."""
    both = edges.select(F.col("left").alias("a"), F.col("right").alias("b"), "score", "support").unionByName(edges.select(F.col("right").alias("a"), F.col("left").alias("b"), "score", "support"))
    s = seeds.select(F.col("topic").alias("a"), "strength")
    x = both.where(F.col("support") >= min_support).join(s, "a").join(s.select(F.col("a").alias("b")), "b", "left_anti")
    x = x.withColumn("v", F.round(F.col("strength") * F.col("score"), 6))
    return x.groupBy(F.col("b").alias("topic")).agg(F.max("v").alias("strength"), F.min_by("a", F.struct(-F.col("v"), F.col("a"))).alias("via")).orderBy(F.desc("strength"), "topic").limit(limit)


def query_plan(mentions: DataFrame, seeds: DataFrame, hop: DataFrame, damping: float = 0.65, limit: int | None = 50) -> DataFrame:
    """Messages by the saturated sum over topics of query weight times best mention weight; direct topics at full strength, related ones damped. via: the topics by what they contribute."""
    q = seeds.select("topic", F.col("strength").alias("q"), F.lit("direct").alias("how")).unionByName(hop.select("topic", (F.col("strength") * damping).alias("q"), F.lit("associated").alias("how")))
    best = mentions.groupBy("message", "topic").agg(F.max("weight").alias("weight"))
    x = best.join(q, "topic").withColumn("c", F.col("q") * F.col("weight"))
    x = x.groupBy("message").agg(F.sum("c").alias("s"), F.count("*").alias("topics"), F.sum((F.col("how") == "direct").cast("long")).alias("direct"), F.array_sort(F.collect_list(F.struct((-F.round("c", 6)).alias("c"), "topic"))).alias("by"))
    x = x.select("message", F.round(S.saturating(F.col("s")), 6).alias("score"), "topics", "direct", F.transform("by", lambda b: b["topic"]).alias("via"))
    return x.orderBy(F.desc("score"), "message").limit(limit) if limit else x
