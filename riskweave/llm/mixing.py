"""Mixing sources to target weights by fixed-length blocks.

Each source's documents form a stream of words in a hashed order, cut into blocks of a fixed length. Every output shard
draws how many of its slots go to each source (multinomial over what the sources have left, so that the sums meet the
targets). A source's slots are numbered through all shards; slot j reads block perm(j mod blocks) of the pass j div
blocks, where perm is a keyed pseudorandom permutation, another one for each pass. Blocks are joined by index.

Null texts have no words and are never taken; null sources are one source, the last. Repeated rows are separate
documents. Reruns agree: all randomness is keyed by the seed. An empty table gives an empty mix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, U64, WORD_GAP, Scratch, mix64, row_keys, table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
REPEATS = 2
BLOCK = 128
#: Rows of a source that one task puts in order.
BUCKET = 20_000
SHARD_BLOCKS, MAX_SHARDS = 4096, 4096


def n_words(text: Column) -> Column:
    words = F.regexp_replace(F.trim(F.coalesce(text, F.lit("")), F.lit(SPACE)), "^$", "")
    return F.when(words == "", 0).otherwise(F.size(F.split(words, WORD_GAP))).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights: tuple = WEIGHTS, share: float = SHARE, repeats: float = REPEATS) -> dict:
    """Source -> target: ``share`` of all words by weight; what exceeds ``repeats`` times a source goes to the others by weight."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    cap = {s: float(repeats * n) for s, n in order}
    left, out, open_ = share * sum(n for _, n in order), {}, [s for s, _ in order]
    while open_:
        whole = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / whole > cap[s]]
        if not over:
            return out | {s: left * weight[s] / whole for s in open_}
        for s in over:
            out[s] = cap[s]
        left -= sum(cap[s] for s in over)
        open_ = [s for s in open_ if s not in out]
    return out


def shard_counts(draws: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """(shards, sources): multinomial draws by what each source has left, never more than that; columns sum to ``draws``."""
    rng, left, out = np.random.default_rng(seed), draws.astype(np.int64).copy(), np.zeros((shards, len(draws)), np.int64)
    for k in range(shards):
        need = int(round(left.sum() / (shards - k)))
        while need > 0:
            got = np.minimum(rng.multinomial(need, left / left.sum()), left)
            out[k] += got
            left -= got
            need -= int(got.sum())
    return out


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray, rounds: int = 4) -> np.ndarray:
    """A keyed permutation of 0 .. n-1, element by element: a Feistel network, walked on until the value is below n."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2).astype(U64)
    mask = (U64(1) << half) - U64(1)
    out, todo = index.astype(U64), np.ones(len(index), bool)
    while todo.any():
        x, h, m, k = out[todo], half[todo], mask[todo], key[todo]
        a, b = x >> h, x & m
        for r in range(rounds):
            a, b = b, a ^ (mix64(b + k + U64((r + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) & m)
        out[todo] = (a << h) | b
        todo[todo] = out[todo] >= n[todo].astype(U64)
    return out.astype(np.int64)


@dataclass
class Mix:
    """``sources``: source -> (index, size, target). ``documents``: the input's keys with size, source index and offset.
    ``slots``: shard, slot, source index, pass, block. ``pieces``: the parts of documents in each block."""

    sources: dict
    documents: DataFrame
    slots: DataFrame
    pieces: DataFrame

    def rows(self) -> DataFrame:
        """The mix itself: for every slot, the pieces of documents in its block."""
        return self.slots.join(self.pieces, ["src", "block"])


def mix(docs: DataFrame, scratch: Scratch, keys: list[Column], text: str = "text", source: str = "source", block: int = BLOCK, seed: int = 42, **rules) -> Mix:
    """Plan the mix of ``docs``; ``keys`` are carried along with each piece."""
    spark = docs.sparkSession
    base = docs.select(*keys, F.col(source).cast("string").alias("source"), n_words(F.col(text).cast("string")).alias("size"))
    names = base.columns[: len(keys)]
    base = scratch.save(base, "sizes")
    sums = base.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()  # one row a source
    target = targets([(r["source"], r["size"]) for r in sums], **rules)
    order = sorted(sums, key=lambda r: (r["source"] is None, r["source"] or ""))
    blocks = np.array([-(-r["size"] // block) for r in order], np.int64)
    draws = np.array([round(target[r["source"]] * b / r["size"]) if r["size"] else 0 for r, b in zip(order, blocks, strict=True)], np.int64)
    shards = int(min(MAX_SHARDS, max(1, draws.sum() // SHARD_BLOCKS)))
    counts = shard_counts(draws, shards, seed)
    first = np.cumsum(counts, axis=0) - counts

    listed = spark.createDataFrame([(r["source"], i, -(-r["n"] // BUCKET)) for i, r in enumerate(order)], "_source string, src int, buckets long")
    placed = base.join(F.broadcast(listed), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), *names), "buckets"))
    starts = placed.groupBy("src", "bucket").agg(F.sum("size").alias("words"))
    starts = starts.withColumn("start", F.sum("words").over(Window.partitionBy("src").orderBy("bucket")) - F.col("words")).drop("words")
    within = Window.partitionBy("src", "bucket").orderBy(*names, "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("offset", F.sum("size").over(within) - F.col("size")).join(starts, ["src", "bucket"])
    placed = placed.select(*names, "source", "src", "size", (F.col("offset") + F.col("start")).alias("offset"))
    placed = scratch.save(placed, "placed")

    last = F.floor((F.col("offset") + F.col("size") - 1) / block)
    pieces = placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("offset") / block), last)))
    begin = F.greatest(F.col("block") * block - F.col("offset"), F.lit(0))
    end = F.least((F.col("block") + 1) * block - F.col("offset"), F.col("size"))
    pieces = pieces.select(*names, "src", "size", "offset", "block", begin.alias("begin"), (end - begin).alias("words"))

    plan = [(k, i, int(first[k, i]), int(counts[k, i]), int(blocks[i])) for k in range(shards) for i in range(len(order)) if counts[k, i]]
    plan = spark.createDataFrame(plan, "shard int, src int, first long, n long, blocks long")
    drawn = plan.withColumn("draw", F.explode(F.expr("sequence(first, first + n - 1)"))).select("shard", "src", "draw", "blocks")

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            src, draw, n = (b.column(i).to_numpy().astype(np.int64) for i in (1, 2, 3))
            turn = draw // n
            key = mix64((src.astype(U64) << U64(32)) + turn.astype(U64) + U64(seed * 0x9E3779B97F4A7C15 % (1 << 64)))
            where = permuted(draw % n, n, key)
            slot = mix64(key + draw.astype(U64)).view(np.int64)  # a shard's slots are in pseudorandom order
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(slot), pa.array(turn), pa.array(where)], names=["shard", "src", "slot", "pass", "block"])

    slots = drawn.mapInArrow(locate, "shard int, src int, slot long, pass long, block long")
    return Mix({r["source"]: (i, r["size"], target[r["source"]]) for i, r in enumerate(order)}, placed, slots, pieces)


def mixed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **rules) -> DataFrame:
    """The mix as documents, with the columns of ``docs``: for every document and pass, the text that its drawn blocks hold.

    A document with all its blocks drawn keeps its text unchanged; of others the undrawn words go, the rest keeps its
    spacing. Documents never drawn are absent; one drawn in two passes occurs twice. ``n_chars``, if there, is counted anew.
    """
    scratch = Scratch(docs.sparkSession, "mixed")
    plan = mix(docs, scratch, row_keys(F.col(key), F.col(text), F.col(source)), text, source, **rules)
    same = Window.partitionBy("k1", "k2")
    spans = plan.rows().groupBy("k1", "k2", "offset", "size", "pass").agg(F.collect_list(F.struct("begin", "words")).alias("_spans"))
    spans = spans.groupBy("k1", "k2", "offset", "size").agg(F.collect_list("_spans").alias("_passes"))
    spans = spans.withColumn("_copy", F.row_number().over(same.orderBy("offset"))).select("k1", "k2", "_copy", "_passes", F.col("size").alias("_size"))
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = {c: names[docs.columns.index(c)] for c in (key, text, source)}
    rows = docs.toDF(*names).select(*row_keys(*(F.col(at[c]) for c in (key, text, source))), "*")
    rows = rows.withColumn("_copy", F.row_number().over(same.orderBy("k1"))).join(spans, ["k1", "k2", "_copy"])
    place = names.index(at[text])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        word = re.compile(r"[^\x20\x09-\x0D]+")
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                take, texts = [], []
                for i, (passes, size, body) in enumerate(zip(part.column("_passes").to_pylist(), part.column("_size").to_pylist(), part.column(place).to_pylist(), strict=True)):
                    ends = None
                    for spans in passes:
                        take.append(i)
                        if sum(s["words"] for s in spans) == size:
                            texts.append(body)
                            continue
                        ends = ends or [m.span() for m in word.finditer(body)]
                        merged: list[list[int]] = []
                        for b, n in sorted((s["begin"], s["words"]) for s in spans):
                            if merged and merged[-1][1] == b:
                                merged[-1][1] = b + n
                            else:
                                merged.append([b, b + n])
                        texts.append("\n".join(body[ends[b][0] : ends[e - 1][1]] for b, e in merged))
                out = pa.RecordBatch.from_arrays([part.column(n) for n in names], names=names).take(pa.array(take, pa.int64()))
                columns = list(out.columns)
                columns[place] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = ", ".join(f"{n} {t}" for n, t in docs.toDF(*names).dtypes)
    out = rows.select(*names, "_passes", "_size").mapInArrow(cut, schema).toDF(*docs.columns)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(text).cast(dict(docs.dtypes)["n_chars"]))
    return out


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix(table(spark, sf_dir, "documents"), Scratch(spark, "mixing"), [F.col("doc_id")])
    sizes = spark.createDataFrame([(i, int(n), float(t)) for i, n, t in plan.sources.values()], "src int, source_size long, target double")
    columns = ["doc_id", "src", "offset", "size"]
    taken = plan.rows().select(*columns, "words").unionByName(plan.documents.where("size > 0").select(*columns, F.lit(0).cast("long").alias("words")))
    taken = taken.groupBy(*columns).agg(F.sum("words").alias("taken"))
    taken = taken.unionByName(plan.documents.where("size = 0").select(*columns, F.lit(0).cast("long").alias("taken")))
    return taken.join(F.broadcast(sizes), "src").select("doc_id", "size", "source_size", "target", "taken")
