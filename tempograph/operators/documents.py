"""Search documents made from facts, and the facts joined back to what a search finds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def clamp(value: int | None, low: int, high: int, default: int) -> int:
    """A limit within its bounds; what isn't a number is the default."""
    try:
        n = int(value)
    except (TypeError, ValueError):
        n = default
    return max(low, min(high, n))


def revision_documents(observations: DataFrame) -> DataFrame:
    """(revision, content, first_seq, last_seq, path): a row for each revision of (revision, content, seq, path). The text is written once, by the first observation; path and last_seq are those of the last."""
    x = observations.groupBy("revision").agg(F.min_by("content", "seq").alias("content"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.max_by("path", "seq").alias("path"))
    return x.select("revision", "content", "first_seq", "last_seq", "path")


def commit_documents(commits: DataFrame, changes: DataFrame, symbols: DataFrame | None = None, existing: DataFrame | None = None) -> DataFrame:
    """(commit, message, content): changed paths, and names of symbols, of each commit in order. commits: (commit, message); changes: (commit, seq, path); symbols: (commit, seq, name). Commits in ``existing`` keep their document, so they are left out."""
    if existing is not None:
        commits = commits.join(existing.select("commit").distinct(), "commit", "left_anti")
    text = lambda d, c, name: d.groupBy("commit").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.col(c).alias("v")))), lambda s: s["v"]), "\n").alias(name))
    x = commits.join(text(changes, "path", "_paths"), "commit", "left")
    parts = [F.col("_paths")]
    if symbols is not None:
        x = x.join(text(symbols, "name", "_names"), "commit", "left")
        parts.append(F.col("_names"))
    return x.select("commit", "message", F.concat_ws("\n", *parts).alias("content"))


def committed(revisions: DataFrame, locations: DataFrame, commits: DataFrame) -> DataFrame:
    """Every location of every revision with its commit; a revision without one has the commit that saw it last. revisions: (revision, last_commit); locations: (revision, commit, path); commits: (commit, ...)."""
    l = locations.select("revision", F.col("commit").alias("_at"), "path")
    x = revisions.join(l, "revision", "left").withColumn("commit", F.coalesce("_at", "last_commit"))
    return x.drop("_at", "last_commit").join(commits, "commit", "left")


def changed_revisions(transitions: DataFrame, revisions: DataFrame) -> DataFrame:
    """Transitions with the revision that they speak of: what they lead to, or where nothing is left, what was there before."""
    return transitions.withColumn("revision", F.coalesce("revision", "prior")).join(revisions, "revision")


def enriched(hits: DataFrame, locations: DataFrame, transitions: DataFrame) -> DataFrame:
    """hits (revision, ...) with their locations (path, seq) in order, the kinds of their transitions, and the number of these. Only facts of the hits are gathered: hits are the rows of a limited search."""
    few = F.broadcast(hits.select("revision").distinct())
    l = locations.join(few, "revision").groupBy("revision").agg(F.array_sort(F.collect_list(F.struct("seq", "path"))).alias("locations"))
    t = transitions.withColumn("revision", F.coalesce("revision", "prior")).join(few, "revision")
    t = t.groupBy("revision").agg(F.array_sort(F.collect_set("kind")).alias("kinds"), F.count("*").alias("transitions"))
    return hits.join(l, "revision", "left").join(t, "revision", "left").withColumn("transitions", F.coalesce("transitions", F.lit(0)))


def previous_symbols(changes: DataFrame, locations: DataFrame, structures: DataFrame | None = None) -> DataFrame:
    """What was in a changed file before, for each change (commit, parent, old_path, new_path): symbols located at exactly the parent and the old path. locations: (commit, path, symbol, ...); structures, where there are any: (symbol, ...)."""
    l = locations.withColumnRenamed("commit", "parent").withColumnRenamed("path", "old_path")
    x = changes.where("parent is not null").join(l, ["parent", "old_path"])
    return x.join(structures, "symbol", "left") if structures is not None else x


def identity_match(previous: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, previous, current, state): symbols of both sides by kind and qualified name; unchanged, modified, added or removed by their revision."""
    p, c = previous.select(*keys, F.col("revision").alias("previous")), current.select(*keys, F.col("revision").alias("current"))
    x = p.join(c, keys, "full_outer")
    state = F.when(F.col("previous").isNull(), "added").when(F.col("current").isNull(), "removed").when(F.col("previous") == F.col("current"), "unchanged").otherwise("modified")
    return x.withColumn("state", state)


def overfetched(ranked: DataFrame, keep: Column, limit: int, historical: bool = False, order: list = ("score",)) -> DataFrame:
    """The first ``limit`` rows that ``keep`` holds for, among the first candidates only: 30 times the limit (300 at least), or 8 times (80) for a historical search, 5000 at most. Filtering first finds more; this is for the same result as a search that filters its candidates."""
    n = min(5000, max(8 * limit, 80) if historical else max(30 * limit, 300))
    return ranked.orderBy(*order).limit(n).where(keep).orderBy(*order).limit(limit)


def in_locale(c: Column, locale: str = "UNICODE") -> Column:
    """A sort key in the order of a locale, where the code points' order isn't wanted."""
    return F.collate(c, locale)


def strict_timestamp(c: Column) -> Column:
    """Whether a text is a time in the one form that it would be written in again: 2024-01-31T00:00:00.000Z."""
    form = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
    return F.coalesce(F.date_format(F.try_to_timestamp(c, F.lit(form)), form) == c, F.lit(False))


def parsed_or(c: Column, schema: str, fallback: Column) -> Column:
    """JSON of a schema, or the fallback where it is null or can't be read."""
    return F.coalesce(F.from_json(c, schema, {"mode": "PERMISSIVE"}), fallback)


def new_receipts(incoming: DataFrame, receipts: DataFrame, key: str = "receipt") -> DataFrame:
    """Imports that weren't taken in before: by their receipt's key, each once; a null key never counts as taken."""
    once = incoming.where(F.col(key).isNotNull()).dropDuplicates([key]).unionByName(incoming.where(F.col(key).isNull()))
    return once.join(receipts.select(key).distinct(), key, "left_anti")


def import_summary(conversations: DataFrame, messages: DataFrame, edges: DataFrame, path: DataFrame) -> DataFrame:
    """(conversation, title, messages, edges, active_path_messages): a row for each conversation, zeros where there is nothing."""
    n = lambda d, name: d.groupBy("conversation").agg(F.count("*").alias(name))
    x = conversations.select("conversation", "title").join(n(messages, "messages"), "conversation", "left").join(n(edges, "edges"), "conversation", "left").join(n(path, "active_path_messages"), "conversation", "left")
    return x.na.fill(0, ["messages", "edges", "active_path_messages"])


def model_status(models: DataFrame, messages: DataFrame, topics: DataFrame) -> DataFrame:
    """Models (fingerprint, created_at, ...) with their numbers of message and topic vectors (fingerprint), the newest first."""
    n = lambda d, name: d.groupBy("fingerprint").agg(F.count("*").alias(name))
    x = models.join(n(messages, "message_vectors"), "fingerprint", "left").join(n(topics, "topic_vectors"), "fingerprint", "left")
    return x.na.fill(0, ["message_vectors", "topic_vectors"]).orderBy(F.desc("created_at"), "fingerprint")


def latency_summary(samples: DataFrame, by: str, value: str) -> DataFrame:
    """min, mean, p50, p95 and max of each group, percentiles by the nearest rank. Ranks are a window over the group, which is sorted, not collected."""
    w = W.partitionBy(by)
    x = samples.where(F.col(value).isNotNull()).select(by, F.col(value).alias("_v"), F.row_number().over(w.orderBy(value)).alias("_r"), F.count("*").over(w).alias("_n"))
    at = lambda q: F.max(F.when(F.col("_r") == F.ceil(F.lit(q) * F.col("_n")), F.col("_v")))
    return x.groupBy(by).agg(F.min("_v").alias("min"), F.round(F.avg("_v"), 6).alias("mean"), at(0.5).alias("p50"), at(0.95).alias("p95"), F.max("_v").alias("max"))
