"""Observations of conversations: latest revisions, snapshots, ledgers, branch points, merges of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def latest(observations: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key by ``order``; plans as a window group limit before the shuffle."""
    return observations.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


#: More sources than this are joined instead of written into the filter.
MANY = 1000


def in_sources(observations: DataFrame, sources: list | None) -> DataFrame:
    """Observations of the sources; all where None is given, none for an empty list."""
    if sources is None or len(sources) <= MANY:
        return observations if sources is None else observations.where(F.col("source").isin(sources))
    kind = observations.schema["source"].dataType.simpleString()
    return observations.join(observations.sparkSession.createDataFrame([(s,) for s in sources], f"source {kind}").distinct(), "source", "left_semi")


def filtered(messages: DataFrame, role: str | None = None, since=None, until=None) -> DataFrame:
    """Optional filters; a message without a time passes the time filters."""
    if since is not None and until is not None and since > until:
        raise ValueError("since is after until")
    if role is not None:
        messages = messages.where(F.col("role") == role)
    for bound, op in ((since, ">="), (until, "<=")):
        if bound is not None:
            t = F.col("created_at")
            messages = messages.where(t.isNull() | ((t >= F.lit(bound)) if op == ">=" else (t <= F.lit(bound))))
    return messages


def current_only(hits: DataFrame, latest_revisions: DataFrame) -> DataFrame:
    """Hits (message, revision) that are their message's latest revision."""
    x = latest_revisions.select(F.col("message").alias("_m"), F.col("revision").alias("_r"))
    return hits.join(x, (F.col("message") == F.col("_m")) & (F.col("revision") == F.col("_r")), "left_semi")


def snapshot(observations: DataFrame, messages: DataFrame) -> DataFrame:
    """Messages of each conversation's latest observation, in chronological order with their number: on the active path first, then by time and id."""
    head = latest(observations, ["conversation"], F.desc("committed_at"), F.desc("seq")).select("conversation", "commit")
    w = W.partitionBy("conversation").orderBy(F.col("active_position").asc_nulls_last(), "created_at", "message")
    return messages.join(head, ["conversation", "commit"]).withColumn("number", F.row_number().over(w))


def snapshot_graph(observations: DataFrame, messages: DataFrame, edges: DataFrame, until=None, commit: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Messages in order with their number, and edges, of each conversation's observation: the latest, the latest until a time, or that of a commit. Edges: (conversation, commit, from, to); those with an end outside are left out."""
    o = observations
    if until is not None:
        o = o.where(F.col("committed_at") <= F.lit(until))
    if commit is not None:
        o = o.where(F.col("commit") == commit)
    m = snapshot(o, messages)
    ends = m.select("conversation", "commit", F.col("message").alias("_m"))
    e = edges
    for side in ("from", "to"):
        e = e.join(ends.withColumnRenamed("_m", side), ["conversation", "commit", side], "left_semi")
    return m, e


def ledger(commits: DataFrame, receipts: DataFrame) -> DataFrame:
    """Receipts for each (ref, commit), zero where there is none."""
    n = receipts.groupBy("ref", "commit").agg(F.count("*").alias("receipts"))
    return commits.join(n, ["ref", "commit"], "left").withColumn("receipts", F.coalesce("receipts", F.lit(0)))


def branch_points(edges: DataFrame) -> DataFrame:
    """Parents with more than one child, for each conversation."""
    return edges.groupBy("conversation", "parent").agg(F.count_distinct("child").alias("children")).where("children > 1")


def merge_records(records: DataFrame, keep: int) -> DataFrame:
    """Last writer wins by id: the larger updated_at, ties by the larger payload; the newest ``keep`` stay, tombstones among them."""
    x = records.groupBy("id").agg(F.max(F.struct("updated_at", "payload", "deleted")).alias("r")).select("id", "r.*")
    return x.orderBy(F.desc("updated_at"), "id").limit(keep)


def first_last(rows: DataFrame, key: str, value: str, seq: str) -> DataFrame:
    """First and last value that isn't null, by seq."""
    x = rows.where(F.col(value).isNotNull())
    return x.groupBy(key).agg(F.min_by(value, seq).alias("first"), F.max_by(value, seq).alias("last"))


def active_flags(messages: DataFrame, paths: DataFrame) -> DataFrame:
    """Adds active, alternate and active_position: path 0 wins, else the first path that holds the node. paths: (conversation, path, node, position)."""
    p = paths.groupBy("conversation", "node").agg(F.min_by("position", "path").alias("active_position"), F.min("path").alias("path"))
    x = messages.join(p, ["conversation", "node"], "left")
    return x.withColumn("active", F.coalesce(F.col("path") == 0, F.lit(False))).withColumn("alternate", F.coalesce(F.col("path") > 0, F.lit(False)))
