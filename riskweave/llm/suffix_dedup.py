"""Suffix-array dedup of bytes: a difference-cover suffix sort, distributed by buckets of suffixes.

Suffixes that share a prefix of ``LENGTH`` bytes share the minimiser of that prefix, so the suffixes dealt out by their
minimiser fall into buckets, each of which holds all of its suffixes' possible neighbours. A bucket's suffix array is made by the
difference-cover algorithm modulo 3: triples at positions that are 1 or 2 modulo 3 are sorted and named, the names are
sorted by recursion until they are unique, the remaining suffixes are sorted by their first byte and the rank behind it, and both orders are merged. Adjacent suffixes are then compared on their first
``LENGTH`` bytes: equal ones are repeats of each other.

Equal pieces of text are sorted once. Buckets of more than ``BUCKET`` different pieces are dealt out further by the
prefix itself: their prefixes' 128-bit hashes are counted with partial sums before any shuffle, and joined back. That
way is exact as well. Equal texts are one text; if there are several rows of one, all its bytes go when it is
long enough. Null texts are empty. Matches never cross documents: a piece ends where its document ends. Rows with equal ids are
separate documents. Empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, ByteHasher, Scratch, as_bytes, runs, signed, table
from .repeats import minimisers, shared_places

LENGTH = 400
GRAM = 64  # bytes of a minimiser
BUCKET = 500  # different pieces
BLOCK = 1 << 18  # bytes of pieces that are sorted at once


def _ranks(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """Order of the rows of some columns, each row's name (equal rows have equal ones), and whether all differ."""
    if max((int(c.max(initial=0)) for c in columns)) < 1 << 21:
        key = columns[0]
        for c in columns[1:]:
            key = (key << 21) | c
        order = np.argsort(key, kind="stable")
        new = key[order][1:] != key[order][:-1]
    else:
        order = np.lexsort(columns[::-1])
        new = np.zeros(max(0, len(order) - 1), bool)
        for c in columns:
            new |= c[order][1:] != c[order][:-1]
    names = np.empty(len(order), np.int64)
    names[order] = np.concatenate(([0], np.cumsum(new)))[: len(order)]
    return order, names, bool(new.all())


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of non-negative symbols below 2 ** 31, by difference cover modulo 3."""
    n = len(text)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), np.int64)
    # 0 is left for the end of the text
    t = np.concatenate((text.astype(np.int64) + 1, np.zeros(4, np.int64)))
    ones = np.arange(1, n + (n % 3 == 1), 3)  # with n = 1 mod 3, the empty suffix parts both kinds in the recursion
    sample = np.concatenate((ones, np.arange(2, n, 3)))
    order, names, unique = _ranks(t[sample], t[sample + 1], t[sample + 2])
    if not unique:
        order = suffix_array(names)
    rank = np.zeros(n + 4, np.int64)  # of sampled suffixes, from 1
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    sampled = sample[order]
    sampled = sampled[sampled < n]
    behind = lambda i: (t[i] << 31) | rank[i + 1]
    rest = np.arange(0, n, 3)
    rest = rest[np.argsort(behind(rest), kind="stable")]
    # merge: how many sampled suffixes of either kind come before each of the rest
    kind1, kind2 = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    before = np.searchsorted(behind(kind1), behind(rest))
    both = np.concatenate((kind2, rest))
    _, pair, _ = _ranks(t[both], t[both + 1])
    pair = (pair << 31) | rank[both + 2]
    before = before + np.searchsorted(pair[: len(kind2)], pair[len(kind2) :])
    out = np.empty(n, np.int64)
    place = before + np.arange(len(rest))
    out[place] = rest
    free = np.ones(n, bool)
    free[place] = False
    out[free] = sampled
    return out


def repeated_prefixes(data: np.ndarray, starts: np.ndarray, counts: np.ndarray, hasher: ByteHasher, length: int = LENGTH) -> np.ndarray:
    """Whether each asked suffix of the joined pieces shares its first ``length`` bytes with another asked one.

    Piece i begins at ``starts[i]`` and asks for its first ``counts[i]`` suffixes.
    """
    order = suffix_array(data)
    asked = np.zeros(len(data), bool)
    where = np.repeat(starts - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
    asked[where] = True
    order = order[asked[order]]
    prefix = np.zeros(len(data), U64)
    sums = hasher.prefix(data)
    prefix[where] = hasher.ranges(sums, where, where + length)
    same = prefix[order][1:] == prefix[order][:-1]
    hit = np.zeros(len(data), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    return hit[where]


def _grams():
    hasher = ByteHasher(21)

    def of(text: str | None) -> np.ndarray:
        data = np.frombuffer(as_bytes(text), np.uint8)
        return hasher.grams(hasher.prefix(data), GRAM) if len(data) >= LENGTH else np.zeros(0, U64)

    return of


def pieces(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """(m, ord, start, count, piece): runs of ``count`` suffixes with one shared minimiser m, with the bytes of their prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _grams()
        names = ["m", "ord", "start", "count", "piece"]
        for batch in batches:
            for i, (text, shared) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2), strict=True)):
                data = as_bytes(text)
                low = minimisers(of(text), length - GRAM + 1)
                if not len(low):
                    continue
                first = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
                count = np.diff(np.append(first, len(low)))
                m = signed(low[first])
                take = np.flatnonzero(np.isin(m, shared.values.field("m").to_numpy()))
                if not len(take):
                    continue
                first, count, m = first[take], count[take], m[take]
                body = pa.array([data[a : a + c + length - 1] for a, c in zip(first.tolist(), count.tolist(), strict=True)], pa.binary())
                ords = pa.array(np.full(len(take), batch.column(0)[i].as_py(), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(m), ords, pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32)), body], names=names)

    return texts.select("ord", "text", "shared").mapInArrow(run, "m long, ord long, start int, count int, piece binary")


def _sort_buckets(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (m, piece_id, count, piece) in the order of m: the runs of repeated suffixes. A block ends where a bucket ends."""
    hasher = ByteHasher(22)

    def solve(held: list) -> pa.RecordBatch:
        bodies = [np.frombuffer(x[2], np.uint8) for x in held]
        starts = np.cumsum([0] + [len(b) for b in bodies[:-1]])
        counts = np.array([x[1] for x in held], np.int64)
        hit = repeated_prefixes(np.concatenate(bodies), starts, counts, hasher)
        ends = np.cumsum(counts)
        # a position between the pieces keeps runs of two pieces apart
        spread = np.zeros(len(hit) + len(counts), bool)
        spread[np.arange(len(hit)) + np.repeat(np.arange(len(counts)), counts)] = hit
        a, b = runs(spread)
        piece = np.searchsorted(ends + np.arange(len(counts)), a)
        shift = (ends - counts + np.arange(len(counts)))[piece]
        ids = np.array([x[0] for x in held], np.int64)[piece]
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array((a - shift).astype(np.int32)), pa.array((b - shift).astype(np.int32))], names=["piece_id", "low", "high"])

    held: list = []
    size, last = 0, None
    for batch in rows:
        for m, i, c, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
            if size >= BLOCK and m != last:
                yield solve(held)
                held, size = [], 0
            held.append((i, c, body.as_py()))
            size += len(held[-1][2])
            last = m
    if held:
        yield solve(held)


def _prefix_rows(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h1, h2, piece_id, at) of every suffix in the pieces of large buckets."""
    one, two = ByteHasher(23), ByteHasher(24)
    for batch in rows:
        for i, c, body in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
            data = np.frombuffer(body.as_py(), np.uint8)
            h = [hasher.ranges(hasher.prefix(data), np.arange(c), np.arange(c) + LENGTH) for hasher in (one, two)]
            yield pa.RecordBatch.from_arrays([pa.array(signed(h[0])), pa.array(signed(h[1])), pa.array(np.full(c, i, np.int64)), pa.array(np.arange(c, dtype=np.int32))], names=["h1", "h2", "piece_id", "at"])


def _join_positions(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(piece_id, at) to the runs of consecutive positions; a piece has few."""
    for batch in rows:
        ids, low, high = [], [], []
        for i, at in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            at = np.sort(at.values.to_numpy())
            cut = np.flatnonzero(np.diff(at) > 1)
            low.append(at[np.concatenate(([0], cut + 1))])
            high.append(at[np.concatenate((cut, [len(at) - 1]))] + 1)
            ids.append(np.full(len(cut) + 1, i, np.int64))
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (ids, low, high)], names=["piece_id", "low", "high"])


def repeated_runs(cut: DataFrame, scratch: Scratch) -> DataFrame:
    """(ord, start, stop): runs of positions at which a repeated prefix starts.

    Equal pieces, such as those inside a passage that many documents hold, are one piece, all of whose suffixes repeat.
    """
    cut = scratch.save(cut.withColumns({"p1": F.xxhash64("piece"), "p2": F.xxhash64("piece", F.lit(2))}), "pieces")
    name = ["m", "p1", "p2"]
    distinct = cut.groupBy(*name).agg(F.first("count").alias("count"), F.max("piece").alias("piece"), F.count("*").alias("copies"))
    distinct = scratch.save(distinct.withColumn("piece_id", F.monotonically_increasing_id()), "distinct")
    sizes = distinct.groupBy("m").agg(F.count("*").alias("n"))
    # a piece alone in its bucket can still repeat within itself; one of several copies repeats anyway
    sized = distinct.join(sizes, "m").where("n > 1 OR copies = 1").select("m", "piece_id", "count", "piece", "n")
    found = "piece_id long, low int, high int"
    usual = sized.where(F.col("n") <= BUCKET).repartition("m").sortWithinPartitions("m").select("m", "piece_id", "count", "piece").mapInArrow(_sort_buckets, found)
    hot = sized.where(F.col("n") > BUCKET).select("m", "piece_id", "count", "piece").mapInArrow(_prefix_rows, "h1 long, h2 long, piece_id long, at int")
    again = hot.groupBy("h1", "h2").count().where("count > 1").select("h1", "h2")
    hot = hot.join(again, ["h1", "h2"]).groupBy("piece_id").agg(F.collect_list("at").alias("at")).mapInArrow(_join_positions, found)
    copied = distinct.where("copies > 1").select("piece_id", F.lit(0).alias("low"), F.col("count").alias("high"))
    ranges = usual.unionByName(hot).unionByName(copied).groupBy("piece_id").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))
    named = distinct.select("piece_id", *name).join(ranges, "piece_id").select(*name, F.explode("ranges").alias("r"))
    placed = cut.select("ord", "start", *name).join(named, name)
    return placed.select("ord", (F.col("start") + F.col("r.low")).alias("start"), (F.col("start") + F.col("r.high")).alias("stop"))


def removed_spans(starts: list, length: int, n: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by the prefixes that start in the given runs."""
    out: list[list[int]] = []
    for a, b in sorted(starts):
        b = min(n, b + length - 1)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def repeated_bytes(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text"):
    """(places, changed): ``changed`` has ord, spans (start and end of removed bytes) and kept (bytes) of first texts that lose any.

    ``places.rows`` has every row with n_bytes, whole (the hash of all its bytes) and copies (rows of its text): a
    text of several rows that is long enough goes whole.
    """
    extra = {"n_bytes": F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("long"), "whole": F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)}
    places = shared_places(docs, scratch, _grams, LENGTH - GRAM + 1, key, text, extra, "n_bytes")
    hits = repeated_runs(pieces(places.texts), scratch).groupBy("ord").agg(F.collect_list(F.struct("start", "stop")).alias("runs"))
    hits = scratch.save(hits, "hits")
    scratch.drop("pieces")
    scratch.drop("distinct")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        for batch in batches:
            spans, kept = [], []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = as_bytes(text)
                gone = removed_spans([(r["start"], r["stop"]) for r in found], LENGTH, len(data))
                spans.append([{"start": a, "stop": b} for a, b in gone])
                ends = [0, *(x for s in gone for x in s), len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["ord", "spans", "kept"])

    changed = places.texts.select("ord", "text").join(hits, "ord").select("ord", "text", "runs").mapInArrow(cut, "ord long, spans array<struct<start:int,stop:int>>, kept binary")
    copies = places.rows.groupBy("ord").agg(F.count("*").alias("copies"))
    places.rows = places.rows.join(copies, "ord")
    return places, changed


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    places, changed = repeated_bytes(table(spark, sf_dir, "documents"), Scratch(spark, "suffixes"))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    changed = changed.select("ord", gone.alias("gone"), F.size("spans").cast("long").alias("spans"), F.sha2("kept", 256).alias("kept"))
    rows = places.rows.join(changed, "ord", "left")
    copy = (F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)
    return rows.select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("gone", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", "whole")).alias("kept_sha256"),
    )
