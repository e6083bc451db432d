"""Helpers shared by the training-data operators: tables, shared work folder, hashing of words."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: `[^\x20\x09-\x0D]+` on UTF-8 bytes is exactly what bytes.split() gives.
_SEPARATORS = bytes(range(0x30)) + bytes(range(0x3A, 0x61)) + bytes(range(0x7B, 0x80))
#: Lower-cases A-Z and turns every byte that is no `[0-9a-z]` or non-ASCII byte into a space.
ALNUM_TABLE = bytes(
    c + 32 if 0x41 <= c <= 0x5A else 32 if c in _SEPARATORS else c for c in range(256)
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only where that is unset (tests)."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        named = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage and survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables written to the shared folder (lineage is cut there); those no longer read are deleted."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = fresh_path(self.spark, name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark._jvm
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(t))[0])
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


BATCH_ROWS = 400


def bounded_batches(spark: SparkSession) -> None:
    """Whole texts go to Python: keep the rows of an Arrow batch few, for bounded memory outside of the heap."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if not 0 < now <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


#: What workers keep from task to task; tasks of other kinds let it go.
CACHES: list[dict] = []


def release(caches: bool = True) -> None:
    """Give back memory that Arrow, the allocator and caches have kept, at the start or end of a task; the worker lives on."""
    for cache in CACHES if caches else ():
        cache.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


PACKED = "_packed_columns"


def pack_columns(docs: DataFrame, *free: str) -> DataFrame:
    """The free columns of docs and one struct of all others, so that no column an operator adds can clash with them."""
    rest = [c for c in docs.columns if c not in free]
    return docs.select(*free, F.struct(*(F.col(f"`{c}`") for c in rest), F.lit(0).alias("_" * (max(map(len, docs.columns)) + 1))).alias(PACKED))


def unpack_columns(df: DataFrame, columns: list[str], *free: str) -> DataFrame:
    return df.select(*(F.col(c) if c in free else F.col(f"{PACKED}.`{c}`") for c in columns))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def gram_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of all runs of `width` words, in order of their starts."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.full(n, np.uint64(width), np.uint64)
    for i in range(width):
        total = mix64(total * GOLDEN + words[i : i + n])
    return total


def texts_as_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = 8 << 20):
    """Parts of a batch with about `limit` bytes of text, one row at least; for bounded memory."""
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0), np.int64)
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)
