"""Shared parts of the corpus operators: shared-folder tables, row keys, byte and word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the contracts' ``[^\x20\x09-\x0D]+`` excludes it. ``bytes.split()`` splits on the same six bytes.
SPACE = " \t\n\x0b\x0c\r"
WORD_GAP = "[\\x20\\x09-\\x0D]+"

#: Rows in a batch for Python workers, at most.
BATCH = 1000

U64 = np.uint64
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where it is unset, one of our own, if driver and executors are one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        jfolder = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = jfolder.get() if jfolder.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that all of them share")
        folder = f"file://{tempfile.mkdtemp(prefix='riskweave-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python workers in batches of few rows: a worker's memory then follows the longest texts, not the batch."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH:
        spark.conf.set(name, str(BATCH))


@contextmanager
def _shuffles_deleted(spark: SparkSession):
    """A query run in here has its shuffle files deleted when it ends, not when the driver next collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


class Scratch:
    """Tables written to the shared folder, so that later jobs neither recompute them nor depend on one executor."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.tables: list[str] = []
        small_batches(spark)
        self.root = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, table: str) -> DataFrame:
        self.tables.append(table)
        path = f"{self.root}/{table}"
        with _shuffles_deleted(self.spark):
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, table: str) -> None:
        """Delete a table that no later step reads."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def keep(self, *tables: str) -> None:
        """Delete all tables but these."""
        for table in [t for t in self.tables if t not in tables]:
            self.drop(table)
        self.tables = [t for t in self.tables if t in tables]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_keys(*cols: Column) -> list[Column]:
    """Two independent 64-bit hashes of the columns, nulls told apart from empty values: a key that is never null."""
    parts = []
    for c in cols:
        parts += [c.isNull(), c]
    return [F.xxhash64(*parts).alias("k1"), F.xxhash64(F.lit("second"), *parts).alias("k2")]


#: Numbers in one sorted partition, at most: they rise from partition to partition by this step.
STEP = 1 << 43


def numbered(df: DataFrame, order: list[Column], size: Column, *keep: str) -> DataFrame:
    """Columns ``keep`` and ``base``: in the order of the rows, the number of each row's first part if it has ``size`` parts.

    Numbers rise in that order, with gaps between partitions of the sort. The result must be written before it is used twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() * STEP
        for batch in batches:
            ends = base + np.cumsum(batch.column(len(keep)).to_numpy())
            firsts = np.concatenate(([base], ends[:-1])) if len(ends) else ends
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(firsts.astype(np.int64))], names=[*keep, "base"])
            base = int(ends[-1]) if len(ends) else base

    rows = df.orderBy(*order).select(*keep, size.cast("long").alias("size"))
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in keep) + ", base long")


def mix64(h: np.ndarray) -> np.ndarray:
    """A finaliser: every bit of the result depends on every bit of ``h``."""
    h = h ^ (h >> U64(32))
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    return h


def _byte_values(seed: int) -> np.ndarray:
    return mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


class ByteHasher:
    """Polynomial hashes modulo 2**64 of byte ranges, from prefix sums; positions are limited only by memory."""

    def __init__(self, seed: int = 7):
        self.values = _byte_values(seed)
        self.power = np.ones(1, U64)
        self.inverse = np.ones(1, U64)

    def _grow(self, n: int) -> None:
        if len(self.power) < n:
            size = max(n, 1 << 16, 2 * len(self.power))
            for name, base in (("power", _BASE), ("inverse", _BASE_INV)):
                p = np.full(size, base, U64)
                p[0] = 1
                setattr(self, name, np.cumprod(p, dtype=U64))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        """Prefix sums s with s[j] - s[i] the hash of data[i:j] times BASE**i."""
        self._grow(len(data) + 1)
        s = np.zeros(len(data) + 1, U64)
        np.cumsum(self.values[data] * self.power[: len(data)], out=s[1:])
        return s

    def ranges(self, s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((s[end] - s[start]) * self.inverse[start] + (end - start).astype(U64))

    def grams(self, s: np.ndarray, k: int) -> np.ndarray:
        n = len(s) - k
        return mix64((s[k:] - s[:n]) * self.inverse[:n]) if n > 0 else np.zeros(0, U64)


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of UTF-8 bytes."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_IS_SPACE[data]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(hasher: ByteHasher, data: np.ndarray) -> np.ndarray:
    start, end = word_bounds(data)
    return hasher.ranges(hasher.prefix(data), start, end)


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every ``n`` consecutive values of ``h``, by doubling; the order of the values counts."""
    if len(h) < n:
        return np.zeros(0, U64)
    out, cur, size, done, rest = None, h, 1, 0, n
    while rest:
        if rest & 1:
            seg = cur[done:]
            out = seg if out is None else mix64(out[: len(seg)] * U64(0xC2B2AE3D27D4EB4F) + seg[: len(out)])
            done += size
        rest >>= 1
        if rest:
            cur = mix64(cur[:-size] * U64(0x9E3779B97F4A7C15) + cur[size:])
            size *= 2
    return out[: len(h) - n + 1]


def sliding_min(g: np.ndarray, w: int) -> np.ndarray:
    """The minimum of every ``w`` consecutive values, by doubling."""
    if len(g) < w:
        return g[:0]
    cur, size = g, 1
    while size * 2 <= w:
        cur = np.minimum(cur[:-size], cur[size:])
        size *= 2
    rest = w - size
    return np.minimum(cur[: len(cur) - rest], cur[rest:]) if rest else cur


def as_bytes(text) -> bytes:
    return b"" if text is None else (text.encode("utf-8", "surrogatepass") if isinstance(text, str) else bytes(text))


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the maximal runs of True."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
