"""Exact top-k search by inner product without random access.

Every block has one list a dimension, sorted by value, which a query reads from the end that is best for the sign of its
component. All lists are read to the same depth, some more each round. What was read gives a row a lower bound (what is
unread counts as the end of its list) and an upper bound (it counts as the entry last read). Rows whose upper bound is below
the k-th largest lower bound, of this block or of blocks read before, are out; once few are left their scores are resolved.

Ties go to the smaller id, rows with one id in the order of their numbers; see ``blocks`` for the rows that take no part.
An empty table gives no rows; fewer candidates than k give all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import blocks
from .common import Scratch, table

#: Sixteenths of the lists that have been read after each round.
DEPTHS = (2, 5, 7, 9, 11, 13)


class Lists:
    """The sorted lists of a block by dimension, from the smallest value: places of their entries in the block ``x``, and values."""

    def __init__(self, x: np.ndarray):
        order = np.argsort(x, axis=0, kind="stable")
        self.x, self.values = x, np.take_along_axis(x, order, axis=0)
        self.places = order * x.shape[1] + np.arange(x.shape[1])

    def survivors(self, q: np.ndarray, k: int, floor: float, own: np.ndarray) -> tuple[np.ndarray, float]:
        """Numbers of the rows that can be among the ``k`` best, and a score that the k-th best has at least; ``own``: rows left out."""
        n, enough = len(self.places), 4 * k
        alive = np.ones(n, bool)
        alive[own] = False
        if not q.size or alive.sum() <= enough:
            return np.flatnonzero(alive), floor
        up, before = q > 0, 0
        value = lambda depth: np.where(up, self.values[n - depth], self.values[depth - 1]) * q
        worst, given, seen = value(n), self.x * q, np.zeros(self.x.shape)  # of ``given`` only what is seen counts
        for part in DEPTHS:
            depth = n * part // 16
            if depth <= before:
                continue
            seen.reshape(-1)[np.where(up, self.places[n - depth : n - before], self.places[before:depth])] = 1
            before, front = depth, value(depth)
            read, unread = np.einsum("ij,ij->i", seen, given), seen @ np.column_stack((worst, front))
            low = (read + (worst.sum() - unread[:, 0]))[alive]
            floor = max(floor, np.partition(low, len(low) - k)[len(low) - k]) if len(low) >= k else floor
            alive &= read + (front.sum() - unread[:, 1]) >= floor
            if alive.sum() <= enough:
                break
        return np.flatnonzero(alive), floor


def _best(score: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((rows, ids, -score))[:k]


def search(rows: DataFrame, is_query: Column, k: int, scale: int, scratch: Scratch) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row (id, label, v) that is a query its ``k`` best others."""
    rows = blocks.numbered_rows(rows, scratch)
    packed = blocks.pack(rows, scratch, "blocks", blocks.BLOCK_BYTES)
    slices = blocks.pack(rows.where(is_query), scratch, "slices", blocks.SLICE_BYTES)
    held: dict = {}  # in a worker: the lists of the block at hand, and what earlier blocks have shown of a slice's k-th scores

    def run(block: blocks.Part, part: blocks.Part, _: dict) -> Iterator[pa.RecordBatch]:
        width = max(block.x.shape[1], part.x.shape[1])
        x, q = block.widened(width), part.widened(width)
        exact = blocks.bound(x, q) < blocks.EXACT_DOUBLE
        if exact and held.get("part") != (block.part, width):
            held.update(part=(block.part, width), lists=Lists(x))
        floors = held.setdefault("floors", {})
        if len(floors) > 256:
            floors.clear()
        floor = floors.setdefault(part.part, np.full(len(q), -np.inf))
        out = []
        for i in range(len(q)):
            own = np.flatnonzero(block.rows == part.rows[i])
            if exact:
                at, floor[i] = held["lists"].survivors(q[i], k, floor[i], own)
            else:  # bounds would not be exact: every row is resolved
                at = np.delete(np.arange(len(x)), own)
            score = blocks.products(x[at], q[i : i + 1])[:, 0]
            best = _best(score, block.ids[at], block.rows[at], k)
            if len(best) == k:
                floor[i] = max(floor[i], float(score[best[-1]]))
            best = best[score[best] >= floor[i]] if exact else best
            out.append((np.full(len(best), part.rows[i]), np.full(len(best), part.ids[i]), block.ids[at[best]], block.rows[at[best]], score[best]))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out, strict=True)], names=["query", "query_id", "vec_id", "row", "score"])

    found = blocks.against(packed, slices, scale, run, "query long, query_id long, vec_id long, row long, score long", scratch, "found")
    scratch.keep("found")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op12_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = blocks.usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return search(rows, F.col("id") % 100 == 0, 10, 1024, Scratch(spark, "topk"))


OP12_SQL = """
WITH good AS (
  SELECT vec_id, embedding FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (
  SELECT vec_id, generate_subscripts(embedding, 1) AS d, CAST(floor(1024 * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS c FROM good
), scores AS (
  SELECT q.vec_id AS query_id, x.vec_id, CAST(sum(q.c * x.c) AS BIGINT) AS score
  FROM parts q JOIN parts x ON q.d = x.d AND q.vec_id <> x.vec_id WHERE q.vec_id % 100 = 0 GROUP BY 1, 2
), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
