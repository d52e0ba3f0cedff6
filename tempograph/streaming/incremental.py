"""Incremental indexing: each input row is processed once, each batch's result and checkpoint appear together.

New files come through an availableNow stream; a batch's output is a folder named by its number, and it counts once its
number is in the manifest, which is written last. A batch that is run again after a failure overwrites its folder, so a
crash at any point leaves either the state before it or after it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F


class Index:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def done(self) -> list[int]:
        """Batches in the manifest."""
        fs, p = self._fs(f"{self.root}/manifest")
        return sorted(int(x.getPath().getName()) for x in fs.listStatus(p)) if fs.exists(p) else []

    def rows(self) -> DataFrame | None:
        paths = [f"{self.root}/batches/{b}" for b in self.done()]
        return self.spark.read.parquet(*paths) if paths else None

    def write(self, batch: DataFrame, number: int, keys: list[str]) -> None:
        """Rows whose keys are new; the manifest entry is the commit."""
        if number in self.done():
            return
        have = self.rows()
        fresh = batch.dropDuplicates(keys)
        if have is not None:
            fresh = fresh.join(have.select(*keys), keys, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{self.root}/batches/{number}")
        fs, p = self._fs(f"{self.root}/manifest/{number}")
        fs.create(p, True).close()

    def update(self, source: str, schema: str, keys: list[str], transform: Callable[[DataFrame], DataFrame] = lambda d: d) -> None:
        """Takes in the files of ``source`` that came since the last update."""
        stream = self.spark.readStream.schema(schema).parquet(source)
        q = stream.writeStream.option("checkpointLocation", f"{self.root}/checkpoint").trigger(availableNow=True).foreachBatch(lambda d, n: self.write(transform(d), n, keys)).start()
        q.awaitTermination()


def upsert(old: DataFrame, new: DataFrame, keys: list[str], seq: str, first: list[str] = ()) -> DataFrame:
    """One row for each key: the columns in ``first`` keep their first value that isn't null, others take the last."""
    x = old.unionByName(new)
    cols = [c for c in x.columns if c not in keys]
    agg = [(F.min_by(c, F.when(F.col(c).isNotNull(), F.col(seq))) if c in first else F.max_by(c, seq)).alias(c) for c in cols]
    return x.groupBy(*keys).agg(*agg)


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"))


def replay_needed(checkpoint_oid: str | None, reached: DataFrame) -> bool:
    """Whether a ref was rewritten: its checkpoint is not among the commits that it reaches now."""
    return checkpoint_oid is not None and reached.where(F.col("oid") == checkpoint_oid).isEmpty()


def stale(have: dict, want: dict) -> bool:
    """Whether a projection must be rebuilt: fingerprint or counts differ."""
    return any(have.get(k) != v for k, v in want.items())
