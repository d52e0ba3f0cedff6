"""Captured conversation observations: limits, credentials, and a parent graph that is closed, acyclic and holds its active path."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from ..operators import graph

MAX_MESSAGES, MAX_TEXT = 20_000, 1 << 20
FORBIDDEN = re.compile(r"(?i)^(?:.*[_-])?(?:authorization|cookies?|set-cookie|password|secret|access[_-]?token|refresh[_-]?token|session[_-]?token|csrf[_-]?token|api[_-]?key)$")


def forbidden_keys(names: Column) -> Column:
    """The keys of an object that may hold a credential."""
    return F.filter(names, lambda k: k.rlike(FORBIDDEN.pattern))


def violations(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """(conversation, rule): everything that makes an observation unacceptable. nodes: (conversation, node, parent, text, keys); conversations: (conversation, current_node, path).

    A cycle is nodes whose walk over known parents never ends.
    """
    rule = lambda df, name: df.select("conversation", F.lit(name).alias("rule")).distinct()
    own = nodes.select(F.col("conversation").alias("_c"), F.col("node").alias("_n")).distinct()
    count = nodes.groupBy("conversation").agg(F.count("*").alias("n"), F.count_distinct("node").alias("d"))
    missing = nodes.where("parent is not null").join(own, (F.col("conversation") == F.col("_c")) & (F.col("parent") == F.col("_n")), "left_anti")
    cyclic = graph.endless(nodes)
    path = conversations.select("conversation", F.posexplode("path").alias("i", "node")).join(nodes.select("conversation", "node", "parent"), ["conversation", "node"], "left")
    prev = conversations.select("conversation", F.posexplode("path").alias("j", "before")).withColumn("i", F.col("j") + 1).drop("j")
    step = path.join(prev, ["conversation", "i"])
    parts = [
        rule(count.where(F.col("n") > MAX_MESSAGES), "too-many-messages"),
        rule(count.where("n > d"), "repeated-node"),
        rule(nodes.where(F.octet_length("text") > MAX_TEXT), "text-too-large"),
        rule(nodes.where(F.size(forbidden_keys(F.coalesce("keys", F.array().cast("array<string>")))) > 0), "credential-key"),
        rule(missing, "unknown-parent"),
        rule(cyclic, "cycle"),
        rule(conversations.where("current_node is not null").join(own, (F.col("conversation") == F.col("_c")) & (F.col("current_node") == F.col("_n")), "left_anti"), "unknown-current-node"),
        rule(step.where("parent is null or parent <> before"), "broken-active-path"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
