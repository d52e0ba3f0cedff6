"""Conversation exports: a zip, a folder or one JSON file, staged safely, and normalised to messages, edges and active paths."""

from __future__ import annotations

import hashlib
import json
import os
import re
import zipfile

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import graph

MAX_FILES, MAX_BYTES, MAX_JSON = 100_000, 20 << 30, 1 << 30
CONVERSATIONS = re.compile(r"(^|/)conversations(?:[-_]\d+)?\.json$")
PATHS = {"source": r"^source\.json$", "receipt": r"^imports/[^/]+/receipt\.json$", "conversation": r"^conversations/(?:[^/]+/)+manifest\.json$"}
MESSAGE = "struct<id: string, author: struct<role: string, name: string>, create_time: double, update_time: double, content: struct<content_type: string, parts: array<string>>, status: string>"
CONVERSATION = f"id string, conversation_id string, title string, create_time double, update_time double, current_node string, mapping map<string, struct<id: string, message: {MESSAGE}, parent: string, children: array<string>>>"


def stage(path: str, into: str) -> list[str]:
    """Files of the export under ``into``; refuses paths that leave it, links, and what is over the limits."""
    if os.path.isfile(path) and not zipfile.is_zipfile(path):
        _limit(1, os.path.getsize(path), [(path, os.path.getsize(path))])
        return [path]
    if os.path.isdir(path):
        files = []
        for root, dirs, names in os.walk(path):
            for n in [*dirs, *names]:
                if os.path.islink(os.path.join(root, n)):
                    raise ValueError(f"a link in the export: {n}")
            files += [os.path.join(root, n) for n in names]
        _limit(len(files), sum(map(os.path.getsize, files)), [(f, os.path.getsize(f)) for f in files])
        return sorted(files)
    with zipfile.ZipFile(path) as z:
        infos = [i for i in z.infolist() if not i.is_dir()]
        _limit(len(infos), sum(i.file_size for i in infos), [(i.filename, i.file_size) for i in infos])
        for i in infos:
            name = i.filename.replace("\\", "/")
            if name.startswith("/") or ".." in name.split("/") or (i.external_attr >> 16) & 0o170000 == 0o120000:
                raise ValueError(f"an unsafe path in the export: {i.filename}")
        z.extractall(into)
        return sorted(os.path.join(into, i.filename) for i in infos)


def _limit(n: int, size: int, each: list[tuple[str, int]]) -> None:
    if n > MAX_FILES or size > MAX_BYTES:
        raise ValueError("the export is too large")
    for name, s in each:
        if name.endswith(".json") and s > MAX_JSON:
            raise ValueError(f"{name} is too large")


def fingerprint(files: list[str], root: str) -> str:
    """sha256 over (path, size, digest) in path order, without a folder that wraps all."""
    names = sorted(os.path.relpath(f, root) for f in files)
    top = {n.split("/")[0] for n in names}
    cut = len(next(iter(top))) + 1 if len(top) == 1 and all("/" in n for n in names) else 0
    h = hashlib.sha256()
    for n in names:
        p = os.path.join(root, n)
        with open(p, "rb") as f:
            h.update(json.dumps([n[cut:], os.path.getsize(p), hashlib.file_digest(f, "sha256").hexdigest()]).encode())
    return h.hexdigest()


def path_kind(c):
    return F.coalesce(*[F.when(c.rlike(p), k) for k, p in PATHS.items()])


def read(spark: SparkSession, files: list[str]) -> DataFrame:
    """Conversations of the export's conversation files, the newest of each id (ties: the later in order of file and place). A file is a list of them, an object that holds the list, or one conversation; one without the text of any is refused."""
    picked = [f for f in files if CONVERSATIONS.search(f)] or [f for f in files if f.endswith(".json")]
    raw = spark.read.text(picked, wholetext=True).select(F.col("_metadata.file_path").alias("_file"), "value")
    wrapped = F.from_json("value", f"conversations array<struct<{CONVERSATION}>>")["conversations"]
    x = raw.select("_file", F.posexplode(F.coalesce(F.when(F.ltrim("value").startswith("{"), wrapped), F.from_json("value", f"array<struct<{CONVERSATION}>>"))).alias("_at", "c"))
    x = x.select(F.struct("_file", "_at").alias("_seq"), "c.*").withColumn("conversation", F.coalesce("conversation_id", "id"))
    x = x.where("conversation is not null")
    return x.groupBy("conversation").agg(F.max_by(F.struct(*[c for c in x.columns if c not in ("conversation", "_seq")]), F.struct(F.coalesce("update_time", F.lit(0.0)), "_seq")).alias("c")).select("conversation", "c.*")


def normalise(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Messages, edges to the nearest ancestor with a message, and the active path."""
    n = conversations.select("conversation", "current_node", F.explode("mapping").alias("node", "v"))
    text = F.array_join(F.filter("v.message.content.parts", lambda p: p.isNotNull()), "\n")
    nodes = n.select("conversation", "node", F.col("v.parent").alias("parent"), F.col("v.message").isNotNull().alias("has_message"), F.col("v.message.author.role").alias("role"), F.col("v.message.create_time").alias("created"), text.alias("content"))
    tree = nodes.select("conversation", "node", "parent", "has_message")
    path = graph.active_path(tree, conversations.select("conversation", F.col("current_node").alias("node")).where("node is not null"))
    have = nodes.where("has_message").select("conversation", "node")
    path = path.join(have, ["conversation", "node"], "left_semi")
    edges = graph.nearest_ancestor(tree)
    return nodes.where("has_message").drop("has_message", "parent"), edges, path
