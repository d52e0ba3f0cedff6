"""Inspection and repair of an index: checkpoints, rewritten refs, jobs, key and reference integrity, gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import graph


def duplicates(table: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return table.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(child: DataFrame, parent: DataFrame, on: dict[str, str]) -> DataFrame:
    """Rows whose reference (child column: parent column) has no row; null references are none."""
    c = child
    for k in on:
        c = c.where(F.col(k).isNotNull())
    p = parent.select(*[F.col(v).alias(f"_p{i}") for i, v in enumerate(on.values())]).distinct()
    return c.join(p, [F.col(k) == F.col(f"_p{i}") for i, k in enumerate(on)], "left_anti")


def inspect(refs: DataFrame, checkpoints: DataFrame, commits: DataFrame, jobs: DataFrame, parents: DataFrame | None = None) -> DataFrame:
    """(ref, head, checkpoint, state): 'missing' without a checkpoint, 'rewritten' where it is no commit that the index knows or, with ``parents`` (child, parent), no ancestor of the head, 'behind' or 'current'; with the numbers of jobs by status."""
    c = checkpoints.select("ref", F.col("oid").alias("checkpoint"))
    known = commits.select(F.col("oid").alias("_k")).distinct()
    x = refs.join(c, "ref", "left").join(known, F.col("checkpoint") == F.col("_k"), "left")
    if parents is not None:
        up = graph.ancestors(parents, x.where("_k is not null and _k <> head").select(F.col("head").alias("root")))
        up = up.select(F.col("root").alias("_r"), F.col("node").alias("_a"))
        x = x.join(up, (F.col("head") == F.col("_r")) & (F.col("_k") == F.col("_a")), "left")
        x = x.withColumn("_k", F.when((F.col("_k") == F.col("head")) | F.col("_a").isNotNull(), F.col("_k")))
    state = F.when(F.col("checkpoint").isNull(), "missing").when(F.col("_k").isNull(), "rewritten").when(F.col("checkpoint") == F.col("head"), "current").otherwise("behind")
    n = jobs.groupBy("ref").pivot("status", ["running", "failed", "completed"]).count().na.fill(0)
    return x.select("ref", "head", "checkpoint", state.alias("state")).join(n, "ref", "left").na.fill(0, ["running", "failed", "completed"])


def gaps(changes: DataFrame, analyses: DataFrame, fingerprint: str) -> DataFrame:
    """Changed blobs without an analysis under this analyzer: what a repair must run."""
    zero = F.col("new_blob").rlike("^0+$")
    have = analyses.where(F.col("fingerprint") == fingerprint).select(F.col("blob_oid").alias("_b"))
    need = changes.where(F.col("new_blob").isNotNull() & ~zero & (F.col("new_mode") != "160000"))
    return need.select("new_blob", "new_path").dropDuplicates(["new_blob"]).join(have, F.col("new_blob") == F.col("_b"), "left_anti")
