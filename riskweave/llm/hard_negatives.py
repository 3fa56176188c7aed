"""Hard negatives by distributed radix selection.

A window belongs to an anchor and asks for the first k rows, by score and then id, whose score lies between two bounds and
whose label is the anchor's, or is another. Scores are never stored: every round computes them anew, block by block, and
counts them by the next digit of their distance from the window's upper bound. The sums of these histograms over all blocks
tell in which bucket the k-th score lies; the window narrows to that bucket until one score is left. Then only rows at or above
it, within the window, are gathered, and of those that tie in a block only the first k.

A block's histogram ends with the bucket in which the block itself reaches k rows: no later bucket can hold the k-th of all.
Windows with fewer than k rows gather all of them. Rows that take no part: see ``blocks``; also those without a label.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import blocks
from .common import Scratch, table

#: Binary digits that a round decides.
BITS = 10
KEY = ("part", "pos", "w")


def _with_windows(slices: DataFrame, windows: DataFrame, *columns: str) -> DataFrame:
    """Each slice with the windows of its queries; a slice's windows are at most its queries times the windows of one."""
    grouped = windows.groupBy("part").agg(F.collect_list(F.struct("pos", "w", *columns)).alias("windows"))
    return slices.join(grouped, "part")


def _columns(windows: list[dict], *names: str) -> list[np.ndarray]:
    return [np.array([w[n] for w in windows], np.int64) for n in names]


def _ways(block: blocks.Part, part: blocks.Part, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Scores of all rows of the block by query, and which of them a query's windows take."""
    width = max(block.x.shape[1], part.x.shape[1])
    score = blocks.products(part.widened(width), block.widened(width))
    alike = part.labels[:, None] == block.labels[None, :]
    return score, alike & (part.rows[:, None] != block.rows[None, :]) if same else ~alike


def select(packed: DataFrame, slices: DataFrame, windows: DataFrame, k: int, same: bool, scale: int, scratch: Scratch, name: str) -> DataFrame:
    """(part, pos, w, rank, id, row, score): the first ``k`` rows of every window (part, pos, w, lo, hi), scores within [lo, hi].

    part and pos: a query by its slice and its place there; ``same``: rows of the query's label, else of other labels.
    """
    windows = scratch.save(windows.where("lo <= hi").select(*KEY, F.col("lo").alias("least"), F.col("hi").alias("most"), "lo", "hi", F.lit(k).cast("long").alias("k")), f"{name}-0")
    span = windows.agg(F.max(F.col("hi") - F.col("lo"))).first()[0] or 0
    shift = max(0, -(-int(span).bit_length() // BITS) * BITS - BITS)
    turn = 0
    while True:

        def count(block: blocks.Part, part: blocks.Part, values: dict, shift: int = shift) -> Iterator[pa.RecordBatch]:
            score, takes = _ways(block, part, same)
            pos, w, lo, hi, left = _columns(values["windows"], "pos", "w", "lo", "hi", "k")
            out = []
            for i in range(len(pos)):
                s = score[pos[i]]
                s = s[takes[pos[i]] & (s >= lo[i]) & (s <= hi[i])]
                if len(s):
                    counts = np.bincount((hi[i] - s) >> shift)
                    counts = counts[: np.searchsorted(np.cumsum(counts), left[i]) + 1]
                    held = np.flatnonzero(counts)
                    out.append((np.full(len(held), pos[i]), np.full(len(held), w[i]), held, counts[held]))
            columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in (np.full(len(columns[0]), part.part), *columns)], names=[*KEY, "bucket", "n"])

        turn += 1
        counted = blocks.against(packed, _with_windows(slices, windows, "lo", "hi", "k"), scale, count, "part long, pos long, w long, bucket long, n long", scratch, f"{name}-counts{turn}", "windows")
        sums = counted.groupBy(*KEY, "bucket").agg(F.sum("n").alias("n"))
        before = F.sum("n").over(Window.partitionBy(*KEY).orderBy("bucket")) - F.col("n")  # at most 2 ** BITS buckets
        hit = sums.withColumn("before", before).join(windows.select(*KEY, "k"), [*KEY]).where("before < k AND before + n >= k").select(*KEY, "bucket", "before")
        top = F.col("hi") - F.shiftleft(F.col("bucket"), shift)
        narrowed = windows.join(hit, [*KEY], "left")
        # a window that never reaches k rows keeps its lower bound as the threshold, and takes part in no further round
        narrowed = narrowed.select(*KEY, "least", "most", F.when(F.col("bucket").isNull(), F.col("least")).otherwise(F.greatest("lo", top - ((1 << shift) - 1))).alias("lo"), F.coalesce(top, "least").alias("hi"), (F.col("k") - F.coalesce("before", F.lit(0))).alias("k"))
        windows = scratch.save(narrowed, f"{name}-{turn}")
        if shift == 0:
            break
        shift -= BITS

    def gather(block: blocks.Part, part: blocks.Part, values: dict) -> Iterator[pa.RecordBatch]:
        score, takes = _ways(block, part, same)
        pos, w, lo, hi = _columns(values["windows"], "pos", "w", "lo", "most")
        out = []
        for i in range(len(pos)):
            s = score[pos[i]]
            at = np.flatnonzero(takes[pos[i]] & (s >= lo[i]) & (s <= hi[i]))
            at = at[np.lexsort((block.rows[at], block.ids[at], -s[at]))[:k]]
            out.append((np.full(len(at), pos[i]), np.full(len(at), w[i]), block.ids[at], block.rows[at], s[at]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in (np.full(len(columns[0]), part.part), *columns)], names=[*KEY, "id", "row", "score"])

    found = blocks.against(packed, _with_windows(slices, windows, "lo", "most"), scale, gather, "part long, pos long, w long, id long, row long, score long", scratch, f"{name}-found", "windows")
    order = Window.partitionBy(*KEY).orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor: Column, scale: int, positives: int, negatives: int, least: int, most: int, scratch: Scratch) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) over rows (id, label, v).

    An anchor's positives are its first rows of the same label; a negative's score lies between ``least`` and ``most``
    hundredths of the positive's.
    """
    rows = blocks.numbered_rows(rows, scratch)
    packed = blocks.pack(rows, scratch, "blocks", blocks.BLOCK_BYTES)
    slices = blocks.pack(rows.where(is_anchor), scratch, "slices", blocks.SLICE_BYTES)
    # no score is larger than the product of two lengths
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + F.pow(F.floor(x * scale).cast("double"), F.lit(2.0))))
    limit = float(blocks.LIMIT)
    longest = min(limit, rows.agg(F.max(F.when(F.isnan(length), limit).otherwise(F.least(length, F.lit(limit))))).first()[0] or 0.0)
    bound = int(min(limit, longest * longest * (1 + 1e-6) + 1))
    places = slices.select("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1)).alias("pos"))
    first = select(packed, slices, places.select("part", "pos", F.lit(0).cast("long").alias("w"), F.lit(-bound).cast("long").alias("lo"), F.lit(bound).cast("long").alias("hi")), positives, True, scale, scratch, "positives")
    first = scratch.save(first.select("part", "pos", F.col("rank").cast("long").alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    share = lambda part: (F.col("positive_score").cast("decimal(20,0)") * part) / F.lit(100).cast("decimal(3,0)")
    windows = first.select(*KEY, F.ceil(share(least)).cast("long").alias("lo"), F.floor(share(most)).cast("long").alias("hi"))
    found = select(packed, slices, windows, negatives, False, scale, scratch, "negatives")

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, ids in zip(batch.column("part").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([part] * (len(ids) // 8), pa.int64()), pa.array(range(len(ids) // 8), pa.int64()), pa.array(np.frombuffer(ids, np.int64))], names=["part", "pos", "anchor_id"])

    anchors = slices.select("part", "ids").mapInArrow(names, "part long, pos long, anchor_id long")
    out = found.join(first, [*KEY]).join(anchors, ["part", "pos"])
    return out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row whose id is divisible by 100 is an anchor; rows whose id is divisible by 7 first get the next label."""
    rows = blocks.usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")
    rows = rows.withColumn("label", F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(rows, F.col("id") % 100 == 0, 256, 5, 10, 30, 90, Scratch(spark, "negatives"))


OP11_SQL = """
WITH good AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (
  SELECT vec_id, label, generate_subscripts(embedding, 1) AS d, CAST(floor(256 * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS c FROM good
), scores AS (
  SELECT a.vec_id AS anchor_id, x.vec_id, a.label = x.label AS alike, CAST(sum(a.c * x.c) AS BIGINT) AS score
  FROM parts a JOIN parts x ON a.d = x.d AND a.vec_id <> x.vec_id WHERE a.vec_id % 100 = 0 GROUP BY 1, 2, 3
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM scores WHERE alike) t WHERE r <= 5
), fitting AS (
  SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id
  WHERE NOT s.alike AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM fitting WHERE rank <= 10
"""
