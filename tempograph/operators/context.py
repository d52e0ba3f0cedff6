"""Message selection around hits, and greedy packing into a token budget with citations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import text as X

PER_MESSAGE, BASE, LEAST = 18, 80, 32


def select_window(messages: DataFrame, hits: DataFrame, radius: int = 2) -> DataFrame:
    """Messages within ``radius`` of a hit on the active path, with priority = least distance. messages: (conversation, message, position); hits: (conversation, position). Each hit makes its 2 * radius + 1 positions, so the join is on equality."""
    near = hits.select("conversation", F.explode(F.transform(F.sequence(F.lit(-radius), F.lit(radius)), lambda d: F.struct((F.col("position") + d).alias("position"), F.abs(d).alias("priority")))).alias("n"))
    near = near.groupBy("conversation", F.col("n.position").alias("position")).agg(F.min("n.priority").alias("priority"))
    return messages.join(near, ["conversation", "position"])


def select_messages(messages: DataFrame, hits: DataFrame, active: DataFrame, edges: DataFrame, radius: int = 2, branches: bool = False) -> DataFrame:
    """(conversation, message, priority): hits with 0; on the active path their neighbours within ``radius``, by distance; of hits off it what an edge ties them to, with 1; with ``branches`` also what an edge ties any of these to, one further.

    messages, hits: (conversation, message); active: (conversation, message, active_position); edges: (conversation, from, to).
    Distance counts messages of the path, so its positions are numbered first. All joins are on equality within a conversation.
    """
    radius = max(0, min(20, radius))
    by = W.partitionBy("conversation").orderBy("active_position", "message")
    path = active.withColumn("i", F.row_number().over(by)).select("conversation", "message", "i")
    hits = hits.select("conversation", "message").distinct()
    on = hits.join(path, ["conversation", "message"])
    steps = F.explode(F.transform(F.sequence(F.lit(-radius), F.lit(radius)), lambda d: F.struct((F.col("i") + d).alias("i"), F.abs(d).alias("priority"))))
    near = on.select("conversation", steps.alias("n")).select("conversation", "n.i", "n.priority").join(path, ["conversation", "i"]).select("conversation", "message", "priority")
    both = edges.select("conversation", F.col("from").alias("message"), F.col("to").alias("other")).unionByName(edges.select("conversation", F.col("to").alias("message"), F.col("from").alias("other")))
    off = hits.join(path, ["conversation", "message"], "left_anti")
    tied = off.join(both, ["conversation", "message"]).select("conversation", F.col("other").alias("message"), F.lit(1).alias("priority"))
    x = hits.withColumn("priority", F.lit(0)).unionByName(near).unionByName(tied)
    x = x.groupBy("conversation", "message").agg(F.min("priority").alias("priority"))
    if branches:
        out = x.join(both, ["conversation", "message"]).select("conversation", F.col("other").alias("message"), (F.col("priority") + 1).alias("priority"))
        x = x.unionByName(out).groupBy("conversation", "message").agg(F.min("priority").alias("priority"))
    return x.join(messages.select("conversation", "message"), ["conversation", "message"], "left_semi")


def best_conversations(selected: DataFrame, hits: DataFrame, limit: int = 8) -> DataFrame:
    """selected, of the conversations with the best hits only: by the smallest rank, then the id. hits: (conversation, rank)."""
    best = hits.groupBy("conversation").agg(F.min("rank").alias("r")).orderBy("r", "conversation").limit(max(1, min(50, limit)))
    return selected.join(F.broadcast(best.select("conversation")), "conversation", "left_semi")


def pack(messages: DataFrame, budget: int = 12_000, group: str = "query") -> DataFrame:
    """Greedy packing of (query, priority, position, message, revision, content) in order of priority and position: what fits is taken whole; a hit (priority 0) that doesn't is cut where 32 tokens or more are left; others are skipped. A revision is taken once. Each query's selection is one bounded group."""
    budget = max(128, min(2_000_000, budget))

    def one(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["priority", "position", "message"], kind="stable")
        used, seen, rows = BASE, set(), []
        est = lambda t: max(1, -(-len(t.encode()) // 4))
        for r in p.itertuples(index=False):
            if r.revision in seen:
                continue
            text, cut = r.content or "[empty message]", False
            cost = est(text) + PER_MESSAGE
            left = budget - used
            if cost > left:
                if r.priority or left - PER_MESSAGE < LEAST:
                    continue
                text, cut = X.truncate_tokens(text, left - PER_MESSAGE)
                cost = min(left, est(text) + PER_MESSAGE)
            used += cost
            seen.add(r.revision)
            rows.append((getattr(r, group), r.message, int(r.position), text, cut, int(cost)))
            if used >= budget:
                break
        rows.sort(key=lambda x: (x[2], x[1]))
        return pd.DataFrame([(*r, f"H{i}") for i, r in enumerate(rows, 1)], columns=[group, "message", "position", "content", "truncated", "cost", "citation"])

    kind = dict(messages.dtypes)
    return messages.groupBy(group).applyInPandas(one, f"{group} {kind[group]}, message {kind['message']}, position int, content string, truncated boolean, cost int, citation string")
