"""Bounded traversal of reference edges, ancestry, active paths, layer projections. Edge lists are DataFrames; the frontier advances a level at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..work import Work

EXPANDS = ("resolved", "exact")
#: What a reported trace may be asked for.
MAX_PATHS, MAX_DEPTH, MAX_STARTS = 10_000, 1000, 1000


def resolve_starts(symbols: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Symbols by id, exact name, prefix or part of the name, in these tiers."""
    if not 0 < limit <= MAX_STARTS:
        raise ValueError(f"limit is within 1..{MAX_STARTS}")
    n, q = F.lower("name"), query.lower()
    tier = F.when(F.col("id") == query, 0).when(F.col("name") == query, 1).when(n.startswith(q), 2).when(n.contains(q), 3)
    return symbols.withColumn("tier", tier).where("tier is not null").orderBy("tier", "name", "id").limit(limit)


def resolve_targets(references: DataFrame, revisions: DataFrame) -> DataFrame:
    """Adds target: the revision of the referenced name at the same commit, else the latest by seq. Dynamic references have none. revisions: (revision, name, commit, seq)."""
    names = references.select("target_name").distinct()
    r = revisions.join(names, revisions["name"] == names["target_name"], "left_semi")
    exact = r.groupBy(F.col("name").alias("n1"), F.col("commit").alias("c1")).agg(F.max_by("revision", "seq").alias("exact"))
    latest = r.groupBy(F.col("name").alias("n2")).agg(F.max_by("revision", "seq").alias("latest"))
    x = references.join(exact, (F.col("target_name") == F.col("n1")) & (F.col("commit") == F.col("c1")), "left").join(latest, F.col("target_name") == F.col("n2"), "left")
    return x.withColumn("target", F.when(F.col("resolution") != "dynamic", F.coalesce("exact", "latest"))).drop("n1", "c1", "exact", "n2", "latest")


def trace(edges: DataFrame, starts: DataFrame, sinks: list[str] = (), max_depth: int = 8, max_paths: int | None = 50, work=None) -> DataFrame:
    """Paths (position, start, nodes, terminal, depth, truncated: whether paths were left out) over edges (source, ordinal, target, target_name, resolution), breadth first.

    A path ends at a sink, an uncertain edge (its resolution), an unresolved target, a cycle, a leaf, or max_depth; only
    resolved and exact edges expand, and the sink test comes first. The first ``max_paths`` are kept, or all where it is
    None, then without position and truncated, and nothing is sorted. ``work.cut`` writes each level where it is given.
    """
    e = edges.select("source", "ordinal", "target", "target_name", "resolution")
    has_out = e.select(F.col("source").alias("node")).distinct()
    order = F.array().cast("array<int>")
    front = starts.select(F.col("id").alias("start"), F.col("id").alias("node"), F.array("id").alias("nodes"), order.alias("ord"))
    done = []
    sink = F.col("target_name").isin(list(sinks)) if sinks else F.lit(False)
    for depth in range(max_depth + 1):
        if depth == max_depth:
            done.append(front.select("start", "nodes", F.lit("max-depth").alias("terminal"), F.lit(depth).alias("level"), "ord"))
            break
        leaf = front.join(has_out, "node", "left_anti")
        done.append(leaf.select("start", "nodes", F.lit("leaf").alias("terminal"), F.lit(depth).alias("level"), "ord"))
        step = front.join(e, front["node"] == e["source"])
        kind = F.when(sink, "sink").when(~F.col("resolution").isin(*EXPANDS), F.col("resolution")).when(F.col("target").isNull(), "unresolved").when(F.array_contains("nodes", F.col("target")), "cycle")
        step = step.select("start", "nodes", F.concat("ord", F.array(F.col("ordinal").cast("int"))).alias("ord"), "target", F.coalesce("target", "target_name").alias("shown"), kind.alias("terminal"))
        if work:
            step = work.cut(step)
        done.append(step.where("terminal is not null").select("start", F.concat("nodes", F.array("shown")).alias("nodes"), "terminal", F.lit(depth).alias("level"), "ord"))
        front = step.where("terminal is null").select("start", F.col("target").alias("node"), F.concat("nodes", F.array("target")).alias("nodes"), "ord")
        if work and front.isEmpty():
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    by = ["level", "start", "ord"]
    if max_paths is None:
        return out.select("start", "nodes", "terminal", F.col("level").alias("depth"))
    if not 0 < max_paths <= MAX_PATHS or not 0 <= max_depth <= MAX_DEPTH:
        raise ValueError(f"max_paths is within 1..{MAX_PATHS}, max_depth within 0..{MAX_DEPTH}")
    # one row more tells whether some are left out
    out = out.orderBy(*by).limit(max_paths + 1).withColumn("position", F.row_number().over(W.orderBy(*by)))
    out = out.withColumn("truncated", F.max("position").over(W.partitionBy(F.lit(0))) > max_paths).where(F.col("position") <= max_paths)
    return out.select("position", "start", "nodes", "terminal", F.col("level").alias("depth"), "truncated")


def _chains(edges: DataFrame, roots: DataFrame, work: Work) -> DataFrame:
    """(node, chain, pos) for nodes inside a chain: one parent and one child, and no root. chain is the top node of its run of them, pos the steps up to it. Pointers double, so rounds are the logarithm of the longest chain."""
    one = edges.groupBy(F.col("child").alias("node")).agg(F.count("*").alias("c"), F.min("parent").alias("parent")).where("c = 1").select("node", "parent")
    kid = edges.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("c")).where("c = 1").select("node")
    inside = one.join(kid, "node", "left_semi").join(roots.select(F.col("root").alias("node")), "node", "left_anti")
    inside = work.cut(inside)
    up = inside.select(F.col("node").alias("parent"), F.lit(True).alias("more"))
    t = work.cut(inside.join(up, "parent", "left").select("node", F.when(F.col("more"), F.col("parent")).otherwise(F.col("node")).alias("chain"), F.when(F.col("more"), 1).otherwise(0).cast("long").alias("pos")))
    longest, reach = inside.count(), 1
    while True:
        top = t.select(F.col("node").alias("chain"), F.col("chain").alias("top"), F.col("pos").alias("further"))
        nxt = work.cut(t.join(top, "chain").select("node", F.col("top").alias("chain"), (F.col("pos") + F.col("further")).alias("pos"), (F.col("further") > 0).alias("moved")))
        work.drop(t)
        t, reach = nxt, reach * 2
        if reach > longest or t.where("moved").isEmpty():
            return t.select("node", "chain", "pos")


def ancestors(edges: DataFrame, roots: DataFrame, levels: int = 4) -> DataFrame:
    """(root, node, depth): everything reached from roots (root) over edges (child, parent), each node once at its least depth.

    Runs of nodes with one parent and one child are taken as one step, so a long line of commits costs no long loop. What
    is left advances ``levels`` steps in each job; a written set of visited nodes keeps merges from being walked again.
    Null ends are no edges, repeated edges count once, a cycle ends where it meets itself; roots needn't have edges.
    """
    work = Work(edges.sparkSession, "ancestors")
    e = work.cut(edges.where("child is not null and parent is not null and child <> parent").select("child", "parent").distinct())
    roots = work.cut(roots.select("root").where("root is not null").distinct())
    inner = _chains(e, roots, work)
    # a cycle of inner nodes has no top: its nodes stand for themselves
    inner = work.cut(inner.join(inner.where("pos = 0").select("chain").distinct(), "chain", "left_semi"))
    enter = inner.select(F.col("node").alias("parent"), "chain", "pos")
    tops = e.join(inner.where("pos = 0").select(F.col("node").alias("child"), "chain"), "child").select("chain", F.col("parent").alias("out"))
    step = e.join(inner.select(F.col("node").alias("child")), "child", "left_anti").join(enter, "parent", "left").join(tops, "chain", "left")
    # from a key node over a chain, if any, to the next key node; w is the number of steps
    step = work.cut(step.select("child", F.coalesce("out", "parent").alias("parent"), "chain", F.coalesce(F.col("pos") + 2, F.lit(1).cast("long")).alias("w")))
    hop = step.groupBy("child", "parent").agg(F.min("w").alias("w"))
    hop = work.cut(hop)
    seen = work.cut(roots.select("root", F.col("root").alias("node"), F.lit(0).cast("long").alias("depth")))
    front = seen
    while True:
        parts, at = [], front
        for _ in range(levels):
            at = at.join(hop, at["node"] == hop["child"]).select("root", F.col("parent").alias("node"), (F.col("depth") + F.col("w")).alias("depth")).groupBy("root", "node").agg(F.min("depth").alias("depth"))
            parts.append(at)
        found = parts[0].withColumn("last", F.lit(levels == 1))
        for i, x in enumerate(parts[1:], 2):
            found = found.unionByName(x.withColumn("last", F.lit(i == levels)))
        found = found.groupBy("root", "node").agg(F.min("depth").alias("depth"), F.min(F.when(F.col("last"), F.col("depth"))).alias("end"))
        old = seen.select("root", "node", F.col("depth").alias("was"))
        new = work.cut(found.join(old, ["root", "node"], "left").where("was is null or depth < was").select("root", "node", "depth", "end"))
        if new.isEmpty():
            break
        nxt = work.cut(seen.unionByName(new.select("root", "node", "depth")).groupBy("root", "node").agg(F.min("depth").alias("depth")))
        work.drop(seen, front)
        seen, front = nxt, new.where("end = depth").select("root", "node", "depth")
    walked = step.where("chain is not null").select(F.col("child").alias("node"), "chain", (F.col("w") - 2).alias("entry"))
    within = seen.join(walked, "node").select("root", "chain", "depth", "entry").join(inner.select(F.col("node").alias("n"), "chain", "pos"), "chain")
    within = within.where("pos <= entry").select("root", F.col("n").alias("node"), (F.col("depth") + 1 + F.col("entry") - F.col("pos")).alias("depth"))
    return seen.unionByName(within).groupBy("root", "node").agg(F.min("depth").cast("int").alias("depth"))


def active_path(nodes: DataFrame, current: DataFrame) -> DataFrame:
    """(conversation, node, position): the walk over parents from the current node, root first. nodes: (conversation, node, parent); current: (conversation, node).

    Jumps over 1, 2, 4, ... parents are joined to the walk so far, so a walk of n nodes takes log n rounds. A node met
    again ends the walk; so does a parent that is no node of the conversation, which still belongs to it. Of a node's
    several parents the smallest counts; a null current node has no walk.
    """
    work = Work(nodes.sparkSession, "path")
    jump = work.cut(nodes.where("node is not null and parent is not null").groupBy("conversation", "node").agg(F.min("parent").alias("to")))
    walk = work.cut(current.where("node is not null").select("conversation", "node", F.lit(0).cast("long").alias("depth")).distinct())
    n, size = 1, walk.count()
    while True:
        more = walk.join(jump, ["conversation", "node"]).select("conversation", F.col("to").alias("node"), (F.col("depth") + n).alias("depth"))
        nxt = work.cut(walk.unionByName(more).groupBy("conversation", "node").agg(F.min("depth").alias("depth")))
        now = nxt.count()
        work.drop(walk)
        walk = nxt
        if now == size:
            break
        size = now
        half = jump.select("conversation", F.col("node").alias("to"), F.col("to").alias("far"))
        further = work.cut(jump.join(half, ["conversation", "to"]).select("conversation", "node", F.col("far").alias("to")))
        work.drop(jump)
        jump, n = further, n * 2
    return walk.withColumn("position", (F.max("depth").over(W.partitionBy("conversation")) - F.col("depth")).cast("int")).select("conversation", "node", "position")


def nearest_ancestor(nodes: DataFrame) -> DataFrame:
    """(conversation, node, ancestor): of each node with a message, the nearest one above that has one too. nodes: (conversation, node, parent, has_message).

    Pointers over nodes without a message double each round. A chain that ends without a message, or in a cycle of such nodes, has none.
    """
    work = Work(nodes.sparkSession, "nearest")
    n = nodes.where("node is not null").groupBy("conversation", "node").agg(F.min("parent").alias("parent"), F.max(F.coalesce("has_message", F.lit(False))).alias("has"))
    n = work.cut(n)
    up = n.select("conversation", F.col("node").alias("parent"), F.col("has").alias("stop"))
    t = work.cut(n.join(up, ["conversation", "parent"]).select("conversation", "node", "has", F.col("parent").alias("at"), "stop"))
    for _ in range(64):
        if t.where("has and not stop").isEmpty():
            break
        far = t.select("conversation", F.col("node").alias("at"), F.col("at").alias("far"), F.col("stop").alias("halt"))
        # a pointer whose end has no pointer of its own has come to a root without a message
        open_ = t.where("not stop").join(far, ["conversation", "at"]).where("far <> node").select("conversation", "node", "has", F.col("far").alias("at"), F.col("halt").alias("stop"))
        nxt = work.cut(t.where("stop").unionByName(open_))
        work.drop(t)
        t = nxt
    return t.where("has and stop").select("conversation", "node", F.col("at").alias("ancestor"))


def endless(nodes: DataFrame) -> DataFrame:
    """(conversation, node): nodes whose walk over parents never ends, as it runs into a cycle. nodes: (conversation, node, parent); a parent that is no node ends a walk; of a node's several parents the smallest counts."""
    work = Work(nodes.sparkSession, "cycles")
    own = nodes.where("node is not null").groupBy("conversation", "node").agg(F.min("parent").alias("at"))
    t = work.cut(own.join(own.select("conversation", F.col("node").alias("at")), ["conversation", "at"]).select("conversation", "node", "at"))
    total, reach = t.count(), 1
    while reach <= total and not t.isEmpty():
        # a pointer to a node that has none of its own has come to an end, and is dropped
        nxt = work.cut(t.join(t.select("conversation", F.col("node").alias("at"), F.col("at").alias("far")), ["conversation", "at"]).select("conversation", "node", F.col("far").alias("at")))
        work.drop(t)
        t, reach = nxt, reach * 2
    return t.select("conversation", "node")


def project(nodes: DataFrame, edges: DataFrame, layer: str) -> DataFrame:
    """Nodes (graph, id, layer) of a projection: all, source, concepts (reference and semantic), or work (work nodes, and the semantic and reference nodes within two edges). The two sweeps are joins."""
    if layer == "all":
        return nodes
    if layer == "source":
        return nodes.where("layer = 'source'")
    if layer == "concepts":
        return nodes.where("layer in ('reference', 'semantic')")
    if layer != "work":
        raise ValueError(layer)
    sel = nodes.where("layer = 'work'").select("graph", "id")
    both = edges.select("graph", F.col("from").alias("a"), F.col("to").alias("b")).unionByName(edges.select("graph", F.col("to").alias("a"), F.col("from").alias("b")))
    soft = nodes.where("layer in ('reference', 'semantic')").select("graph", F.col("id").alias("b"))
    for _ in range(2):
        nxt = both.join(sel.select("graph", F.col("id").alias("a")), ["graph", "a"], "left_semi").join(soft, ["graph", "b"], "left_semi")
        sel = sel.unionByName(nxt.select("graph", F.col("b").alias("id"))).distinct()
    return nodes.join(sel, ["graph", "id"], "left_semi")
