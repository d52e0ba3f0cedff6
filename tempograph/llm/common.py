"""Shared pieces: work tables on the shared folder, and vectorised views of UTF-8 text."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T

U64 = np.uint64
_P = U64(0x9E3779B97F4A7C15 | 1)


def work_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; a temporary one only where it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = f"file://{tempfile.gettempdir()}/tempograph-work"
    return path


class Work:
    """Written tables that cut the lineage; they outlive the loss of any executor."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}", 0

    def cut(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        schema = df.schema
        df.write.parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out._tg_path = path
        return out

    def drop(self, *dfs: DataFrame) -> None:
        """Frees tables that no later plan reads."""
        for df in dfs:
            if path := getattr(df, "_tg_path", None):
                jvm = self.spark.sparkContext._jvm
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


_model: dict = {}


def release() -> None:
    """Frees the model that this Python worker holds. Every function that runs in a worker without one calls it, as workers outlive their tasks."""
    if _model:
        _model.clear()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library keeps its free memory
            pass


def held(key: tuple, make: Callable):
    """The model of that key; a worker holds one at a time, whichever operator it is of."""
    if key not in _model:
        release()
        _model[key] = make()
    return _model[key]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def integral(df: DataFrame, name: str) -> None:
    """Refuses ids that aren't integers: a cast would fail in the middle of a job, or make them null."""
    if not isinstance(df.schema[name].dataType, T.IntegralType):
        raise ValueError(f"{name} must be of an integer type, not {df.schema[name].dataType.simpleString()}")


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    _, off, data = col.buffers()
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(off, np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def slices(off: np.ndarray, size: int = 1 << 20):
    """Runs of rows with about ``size`` bytes in each, to bound the working memory of one step."""
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_pow = np.ones(1, U64)


def powers(n: int) -> np.ndarray:
    global _pow
    if len(_pow) < n:
        with np.errstate(over="ignore"):
            _pow = np.concatenate([np.ones(1, U64), np.cumprod(np.full(max(n, 4096), _P, U64))])
    return _pow


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span; spans are in order, don't overlap and aren't empty."""
    if not len(start):
        return np.zeros(0, U64)
    length = end - start
    total = int(length.sum())
    first = np.concatenate([[0], np.cumsum(length)[:-1]])
    rel = np.arange(total) - np.repeat(first, length)
    at = rel + np.repeat(start, length)
    with np.errstate(over="ignore"):
        v = (data[at].astype(U64) + U64(1)) * powers(int(length.max()) + 1)[rel]
        return mix(np.add.reduceat(v, first) ^ (length.astype(U64) << U64(48)))


_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs of ASCII letters and digits and of non-ASCII characters): start, end, hash, and the first word's index for each row (n + 1 of them)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(len(off), np.int64)
    is_word = _WORD[data]
    first = np.zeros(len(data), bool)
    first[off[:-1][off[:-1] < len(data)]] = True
    before = np.concatenate([[False], is_word[:-1]])
    start = np.flatnonzero(is_word & (~before | first))
    after = np.concatenate([is_word[1:], [False]])
    last = np.concatenate([first[1:], [True]])
    end = np.flatnonzero(is_word & (~after | last)) + 1
    return start, end, span_hash(data, start, end), np.searchsorted(start, off)
