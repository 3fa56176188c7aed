"""Where long repeats can be: shared minimisers.

Every window of a fixed length has a minimiser, the least hash of the grams inside it. Equal windows have equal
minimisers, so a window can only occur again if its minimiser does. Minimisers are few (about two for each window
length), counting them over the whole corpus is cheap, and only texts, and windows in them, with a minimiser found twice or more
go on. Nothing is lost by this, and nothing is decided: the operators compare what goes on exactly.

Equal texts are compared once: the first row of each text (by id, null last) stands for all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, Scratch, mix64, numbered, row_keys, signed, sliding_min


def minimisers(grams: np.ndarray, w: int) -> np.ndarray:
    """The minimiser of every window of ``w`` grams."""
    return sliding_min(mix64(grams ^ U64(0xA0761D6478BD642F)), w)


def listed(grams: np.ndarray, w: int) -> np.ndarray:
    """A text's distinct minimisers; those of grams that it has twice or more, twice."""
    h = mix64(grams ^ U64(0xA0761D6478BD642F))
    low = sliding_min(h, w)
    if not len(low):
        return low
    own = np.unique(low[np.concatenate(([True], low[1:] != low[:-1]))])
    again = np.sort(h[h <= own[-1]]) if len(own) else h[:0]
    again = again[1:][again[1:] == again[:-1]]
    return np.concatenate((own, np.intersect1d(own, again)))


@dataclass
class Places:
    """``rows``: k1, k2, id, t1, t2, ord for every input row, ord being the number of its text's first word or byte in the
    order of ids; ``first``: whether the row is that first one; ``texts``: ord, text, shared (minimiser, count) of first rows that have any."""

    rows: DataFrame
    texts: DataFrame


def shared_places(docs: DataFrame, scratch: Scratch, grams: Callable[[], Callable], w: int, key: str, text: str, extra: dict, size: str) -> Places:
    """``grams()`` makes, in a worker, the function from a text to its gram hashes; ``extra``: further columns of rows, by
    name; ``size``: the one that has the number of words or bytes."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    k, t = row_keys(F.col("id"), F.col("text")), [c.alias(n) for c, n in zip(row_keys(F.col("text")), ("t1", "t2"), strict=True)]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = grams()
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                found = [listed(of(x), w) for x in part.column(1).to_pylist()]
                ends = np.cumsum([0] + [len(f) for f in found])
                values = pa.array(signed(np.concatenate(found).astype(U64)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], names=["t1", "mins"])

    mins = rows.select(t[0], "text").mapInArrow(scan, "t1 long, mins array<long>")
    mins = scratch.save(mins.where(F.size("mins") > 0), "mins")
    each = mins.select("t1", F.explode("mins").alias("m"))
    again = each.groupBy("m").agg(F.count("*").cast("int").alias("n")).where("n > 1")
    cand = each.join(again, "m").groupBy("t1").agg(F.collect_set(F.struct("m", "n")).alias("shared"))
    cand = scratch.save(cand, "cand")
    scratch.drop("mins")

    whole = scratch.save(rows.select(*k, *t, "id", *[c.alias(n) for n, c in extra.items()]), "rows")
    place = F.struct(F.col("id").isNull().alias("last"), "id", "k1", "k2")
    first = whole.groupBy("t1", "t2").agg(F.min(place).alias("p"), F.max(size).alias("size"))
    # one number more than parts, so that no two texts begin at the same one
    first = scratch.save(numbered(first, ["p"], F.col("size") + 1, "t1", "t2", "p").withColumnRenamed("base", "ord"), "first")
    whole = whole.join(first, ["t1", "t2"])
    whole = whole.withColumn("first", F.col("id").eqNullSafe(F.col("p.id")))
    whole = scratch.save(whole.drop("p"), "placed")
    heads = first.join(cand, "t1").select("p.k1", "p.k2", "ord", "shared")
    # repeated rows stand side by side after the join: the first of them is enough
    once = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("k1"))
    texts = rows.select(*k, "text").join(heads, ["k1", "k2"]).withColumn("copy", once).where("copy = 1")
    texts = scratch.save(texts.select("ord", "text", "shared"), "texts")
    scratch.drop("cand")
    return Places(whole, texts)
