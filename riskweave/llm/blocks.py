"""Vectors in packed blocks: a stated set of query rows against all rows of a table, block against slice.

A block holds some thousand rows of the table, a slice some hundred queries, both bounded in bytes, so a pair of them is
one bounded piece of work wherever it runs. Components are floor(scale * x) as whole numbers, and inner products are exact:
double precision while every product of the pair fits it, 64-bit integers while those do, Python's integers beyond.

Rows without an id, without a vector, or with a null or non-finite component take no part. A shorter vector counts as
filled up with zeros. Rows that share an id are rows of their own; scores beyond ``LIMIT`` in magnitude count as ``LIMIT``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

#: Bytes of components in a block and in a slice, at most (a longer vector is alone).
BLOCK_BYTES, SLICE_BYTES = 1 << 20, 1 << 17
#: Scores lie within this magnitude.
LIMIT = 1 << 61
#: Whole numbers below are exact in double precision, and in 64-bit integers.
EXACT_DOUBLE, EXACT_LONG = 1 << 53, 1 << 62

PACKED = "part long, n int, dims int, ids binary, rows binary, labels binary, x binary"
#: Pairs of a block and a slice in one Arrow batch: their bytes bound it.
PAIRS = 8


def usable(df: DataFrame, key: str, vector: str, label: str | None = None) -> DataFrame:
    """(id, label, v): the rows that take part; without ``label`` every row has label 0."""
    v = F.col(vector).cast("array<double>")
    rows = df.select(F.col(key).cast("long").alias("id"), (F.col(label).cast("long") if label else F.lit(0).cast("long")).alias("label"), v.alias("v"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(F.exists("v", bad), F.lit(False)))


def pack(rows: DataFrame, scratch: Scratch, name: str, most: int) -> DataFrame:
    """Rows (id, label, row, v) as parts of at most ``most`` bytes of components, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, labels, numbers = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
            vectors = batch.column(3)
            flat, ends = vectors.flatten().to_numpy(zero_copy_only=False), np.cumsum(vectors.value_lengths().to_numpy(zero_copy_only=False))
            starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
            width = int(np.max(ends - starts, initial=0))
            step = max(1, most // max(8, 8 * width))
            for low in range(0, len(ids), step):
                pick = slice(low, low + step)
                begin, size = starts[pick], (ends - starts)[pick]
                x = np.zeros((len(begin), width))
                inside = np.arange(width)[None, :] < size[:, None]
                x[inside] = flat[(begin[:, None] + np.arange(width)[None, :])[inside]]
                columns = [[part], [len(begin)], [width], *[[a[pick].tobytes()] for a in (ids, numbers, labels)], [x.tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 4), strict=True)], names=["part", "n", "dims", "ids", "rows", "labels", "x"])
                part += 1

    size = rows.agg(F.sum(8 * F.greatest(F.size("v"), F.lit(1)))).first()[0] or 0
    return scratch.save(rows.repartition(size // most + 1).select("id", "label", "row", "v").mapInArrow(run, PACKED), name)


def numbered_rows(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows with a number of their own each, ``row``, written so that it stays the same."""
    return scratch.save(rows.withColumn("row", F.monotonically_increasing_id()), "rows")


def scaled(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): as doubles while all are exact, else as Python's integers; with scale 0 the components as they are."""
    if not scale:
        return x
    if not x.size or np.abs(x).max() < EXACT_DOUBLE / scale:
        return np.floor(x * scale)
    # so large a double is a whole number
    return np.array([int(v) * scale if abs(v) >= EXACT_DOUBLE / scale else int(np.floor(v * scale)) for v in x.ravel().tolist()], object).reshape(x.shape)


def _most(x: np.ndarray) -> int:
    return int(max(abs(x.max()), abs(x.min()))) if x.size else 0


def bound(a: np.ndarray, b: np.ndarray) -> int:
    """No sum of products of components is larger."""
    return _most(a) * _most(b) * max(a.shape[1], 1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of two matrices of whole numbers, exact, as 64-bit integers within ``LIMIT``."""
    most = bound(a, b)
    if most < EXACT_DOUBLE:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    if most < EXACT_LONG:
        return np.clip(a.astype(np.int64) @ b.astype(np.int64).T, -LIMIT, LIMIT)
    whole = lambda x: np.array([int(v) for v in x.ravel().tolist()], object).reshape(x.shape)
    out = whole(a) @ whole(b).T
    return np.array([min(max(v, -LIMIT), LIMIT) for v in out.ravel().tolist()], np.int64).reshape(out.shape)


@dataclass
class Part:
    """A block or a slice, unpacked."""

    part: int
    ids: np.ndarray
    rows: np.ndarray
    labels: np.ndarray
    x: np.ndarray

    @staticmethod
    def of(batch: pa.RecordBatch, i: int, prefix: str, scale: int) -> Part:
        at = lambda name: batch.column(f"{prefix}_{name}")[i].as_py()
        n, dims = at("n"), at("dims")
        whole = lambda name: np.frombuffer(at(name), np.int64)
        return Part(at("part"), whole("ids"), whole("rows"), whole("labels"), scaled(np.frombuffer(at("x")).reshape(n, dims), scale))

    def widened(self, width: int) -> np.ndarray:
        return self.x if self.x.shape[1] == width else np.concatenate((self.x, np.zeros((len(self.x), width - self.x.shape[1]), self.x.dtype)), axis=1)


@contextmanager
def small_pairs(spark: SparkSession):
    """Jobs in here send Python workers few rows at a time: the rows are pairs of whole blocks."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(PAIRS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def against(blocks: DataFrame, slices: DataFrame, scale: int, run: Callable[[Part, Part, dict], Iterator[pa.RecordBatch]], schema: str, scratch: Scratch, name: str, *more: str) -> DataFrame:
    """Every block meets every slice once: ``run(block, slice, values)`` gives batches of ``schema``; written to the shared folder.

    ``more``: further columns of the slices, as ``values``. Blocks are not moved: Spark sends them the slices, as a broadcast
    while these are small by its own measure.
    """
    left = blocks.select([F.col(c).alias(f"b_{c}") for c in blocks.columns])
    right = slices.select([F.col(c).alias(f"s_{c}") if c not in more else F.col(c) for c in slices.columns])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, slices = None, {}
        for batch in batches:
            for i in range(batch.num_rows):
                which = batch.column("b_part")[i].as_py()
                if block is None or block.part != which:
                    block = Part.of(batch, i, "b", scale)
                which = batch.column("s_part")[i].as_py()
                if which not in slices:
                    if len(slices) >= 64:
                        slices.clear()
                    slices[which] = Part.of(batch, i, "s", scale)
                yield from run(block, slices[which], {c: batch.column(c)[i].as_py() for c in more})

    with small_pairs(blocks.sparkSession):
        return scratch.save(left.crossJoin(right).mapInArrow(step, schema), name)
