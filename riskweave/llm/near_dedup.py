"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles, banded, verified exactly.

A document is its weighted set of five-word shingles: weight = occurrences x idf, the idf from counts over all documents
in a fixed number of hash buckets (so the table of counts has one size for any corpus). ICWS draws samples that agree
between two sets with a chance of their weighted Jaccard similarity. Bands of samples are keys; texts with equal keys
are candidates. Rounds of linearly many candidates come first: in every bucket that holds several classes each text of
another class than the bucket's head meets that head, the first text in an order of the round. Buckets that are then still of several
classes get an exact
remainder: of two texts as similar as the threshold, the first shingle in common, the rarest ones counted first, lies in
the early part of both, so texts are joined on the shingles of their early parts, and all pairs left by the bounds on
weights and positions are compared. Candidates are verified by the exact weighted Jaccard similarity, at first the best
ones, then all between texts not yet in one class.

Equal texts are one text from the start. Classes are the connected components of links; the earliest document of a class
(smallest doc_id, null last) stays. Texts of fewer than five words are one shingle, their words; texts without words
(null, empty, white space) are never near anything, but equal ones are copies. Repeated rows are copies of each other.
Empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import U64, ByteHasher, Scratch, as_bytes, mix64, row_keys, signed, table, window_hashes, word_hashes
from .components import components


@dataclass(frozen=True)
class Settings:
    words: int = 5
    similarity: float = 0.8
    bands: int = 16
    rows: int = 3
    buckets: int = 1 << 18  # of the idf table
    rounds: int = 2  # of heads, before the exact remainder
    seed: int = 3

    @property
    def samples(self) -> int:
        return self.bands * self.rows


CHUNK = 1 << 15  # shingles sampled at once
PIECE = 1024  # idf counts in one row


def shingles(hasher: ByteHasher, text: str | None, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending, and how often each occurs."""
    h = word_hashes(hasher, np.frombuffer(as_bytes(text), np.uint8))
    grams = window_hashes(h, min(words, len(h))) if len(h) else h
    return np.unique(grams, return_counts=True)


def idf(counts: np.ndarray, documents: int) -> np.ndarray:
    return np.log(1 + documents / (1 + counts.astype(float)))


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two (ascending hashes, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = np.minimum(a[1][i], b[1][j]).sum()
    whole = a[1].sum() + b[1].sum() - common
    return float(common / whole) if whole else 0.0


class Sampler:
    """ICWS: for sample k, a shingle's (r, c, beta) are those of a table entry that its hash picks for k."""

    def __init__(self, s: Settings):
        rng = np.random.default_rng(s.seed)
        n = 1 << 16
        self.r = rng.gamma(2, 1, n).astype(np.float32)
        self.log_c = np.log(rng.gamma(2, 1, n)).astype(np.float32)
        self.beta = rng.random(n).astype(np.float32)
        self.odd = mix64(np.arange(1, s.samples + 1, dtype=U64) + U64(s.seed << 32)) | U64(1)
        self.s = s

    def __call__(self, h: np.ndarray, log_w: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """(documents, samples): the sampled shingle's hash; ``starts``: where each document begins in ``h``."""
        out = np.zeros((len(starts), self.s.samples), U64)
        lengths = np.diff(np.append(starts, len(h)))
        for k, odd in enumerate(self.odd):
            at = (h * odd) >> U64(48)
            r, beta = self.r[at], self.beta[at]
            a = self.log_c[at] - r * (np.floor(log_w / r + beta) - beta) - r
            least = np.minimum.reduceat(a, starts)
            hit = np.flatnonzero(a == np.repeat(least, lengths))
            out[:, k] = h[hit[np.searchsorted(hit, starts)]]
        return out


def idf_table(texts: DataFrame, s: Settings) -> np.ndarray:
    """idf by bucket from all rows of (text): tasks send their counts in pieces, merged in two steps."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, counts, documents, salt = ByteHasher(), np.zeros(s.buckets, np.int64), 0, 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                h, _ = shingles(hasher, text, s.words)
                counts += np.bincount((h & U64(s.buckets - 1)).astype(np.int64), minlength=s.buckets) if len(h) > s.buckets else 0
                if len(h) <= s.buckets:
                    np.add.at(counts, (h & U64(s.buckets - 1)).astype(np.int64), 1)
                documents += 1
                salt ^= int(h[0]) if len(h) else 0
        pieces = [counts[i : i + PIECE].tobytes() for i in range(0, s.buckets, PIECE)] + [np.array([documents], np.int64).tobytes()]
        n = len(pieces)
        yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array([salt % 64] * n, pa.int32()), pa.array(pieces, pa.binary())], names=["piece", "salt", "counts"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, np.int64) for x in rows["counts"])
        return pd.DataFrame({"piece": rows["piece"].iloc[:1], "salt": [0], "counts": [total.tobytes()]})

    schema = "piece int, salt int, counts binary"
    rows = texts.mapInArrow(count, schema).groupBy("piece", "salt").applyInPandas(add, schema).groupBy("piece").applyInPandas(add, schema).orderBy("piece").collect()
    if not rows:
        return np.zeros(s.buckets)
    counts = np.concatenate([np.frombuffer(r["counts"], np.int64) for r in rows])
    return idf(counts[: s.buckets], int(counts[s.buckets]))


def _signatures(texts: DataFrame, weights, s: Settings) -> DataFrame:
    """(t1, t2, sig, bands) for every row of (t1, t2, text) with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, sampler, idf_of = ByteHasher(), Sampler(s), weights.value
        band_salt = mix64(np.arange(1, s.bands + 1, dtype=U64))

        def flush(rows: list, hashes: list, logs: list, batch: pa.RecordBatch) -> pa.RecordBatch:
            starts = np.cumsum([0] + [len(h) for h in hashes[:-1]])
            sig = sampler(np.concatenate(hashes), np.concatenate(logs).astype(np.float32), starts)
            keys = band_salt[None, :]
            for r in range(s.rows):
                keys = mix64(keys * U64(0x9E3779B97F4A7C15) + sig[:, r :: s.rows])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, s.bands), pa.int32()), pa.array(signed(np.ascontiguousarray(keys)).reshape(-1)))
            short = (sig & U64(0xFFFF)).astype("<u2")
            part = batch.take(pa.array(rows, pa.int64()))
            return pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([x.tobytes() for x in short], pa.binary()), lists], names=["t1", "t2", "sig", "bands"])

        for batch in batches:
            rows, hashes, logs, n = [], [], [], 0
            for i, text in enumerate(batch.column(2).to_pylist()):
                h, tf = shingles(hasher, text, s.words)
                if not len(h):
                    continue
                rows.append(i)
                hashes.append(h)
                logs.append(np.log(tf * idf_of[(h & U64(s.buckets - 1)).astype(np.int64)]))
                n += len(h)
                if n >= CHUNK:
                    yield flush(rows, hashes, logs, batch)
                    rows, hashes, logs, n = [], [], [], 0
            if rows:
                yield flush(rows, hashes, logs, batch)

    return texts.mapInArrow(run, "t1 long, t2 long, sig binary, bands array<long>")


def _agreement(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 1)) for i in (2, 3))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((a == b).mean(axis=1).astype(float)), *batch.columns[4:]], names=["a", "b", "est", "ra", "rb"])


NODE = "struct<t1:bigint,t2:bigint>"
EPS = 1e-9  # of sums of weights
BEFORE = 8  # shingles before one in a text's order that tell whether a pair has met already


def _candidates(members: DataFrame, roots: DataFrame, turn: int) -> DataFrame:
    """(a, b) from (key, node): in every bucket of several classes, each text of another class than the bucket's head and that head.

    The head is the first one in an order of this round that is the same for all buckets, so buckets that hold the same
    texts have one head. Heads come from a partial aggregation, and the join with them can be split: no bucket is one task.
    """
    rows = members.join(roots, "node").withColumn("o", F.xxhash64("node", F.lit(turn)))
    heads = rows.groupBy("key").agg(F.min(F.struct("o", "node", "root")).alias("head"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    apart = rows.join(heads.select("key", "head"), "key").where("root <> head.root").select("node", F.col("head.node").alias("other"))
    return apart.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def _estimated(pairs: DataFrame, sigs: DataFrame, roots: DataFrame, s: Settings) -> DataFrame:
    """(a, b, est, ra, rb) of the pairs whose samples do not tell that they are far below the threshold, with the roots of their classes."""
    known = sigs.join(roots, "node")
    side = lambda c: known.select(F.col("node").alias(c), F.col("sig").alias(f"sig{c}"), F.col("root").alias(f"r{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "siga", "sigb", "ra", "rb")
    # five standard deviations below the threshold
    least = s.similarity - 5 * (s.similarity * (1 - s.similarity) / s.samples) ** 0.5
    return both.mapInArrow(_agreement, f"a {NODE}, b {NODE}, est double, ra {NODE}, rb {NODE}").where(F.col("est") >= least)


def early(h: np.ndarray, w: np.ndarray, idf_of: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Of (ascending hashes, weights): the hashes with at most ``share`` of the weight before them, by falling idf, and the weight from each one on."""
    order = np.lexsort((h, -idf_of))
    rest = np.cumsum(w[order][::-1])[::-1]
    n = int(np.count_nonzero(rest >= (1 - share - EPS) * rest[0]))
    return h[order[:n]], rest[:n]


def _prefixes(texts: DataFrame, weights, s: Settings) -> DataFrame:
    """(node, h, whole, rest, before) of (node, text): the shingles that can be the first in common with a similar text, in one order for all texts.

    With similarity t the common weight is t / (1 + t) of both weights' sum at least, and none of it lies before the
    first common shingle: before it is at most 1 - t of the heavier text and (1 - t) / (1 + t) of the lighter one.
    ``before`` are the last shingles before one, at most ``BEFORE``: two texts that share one of them have met there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, idf_of = ByteHasher(), weights.value
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                part = batch.slice(low, 64)
                hs, rests, n, before, ends = [], [], [], [], [0]
                for text in part.column(1).to_pylist():
                    h, tf = shingles(hasher, text, s.words)
                    each = idf_of[(h & U64(s.buckets - 1)).astype(np.int64)]
                    h, rest = early(h, tf * each, each, 1 - s.similarity)
                    hs.append(h)
                    rests.append(rest)
                    n.append(len(h))
                    for i in range(len(h)):
                        before.append(h[max(0, i - BEFORE) : i])
                        ends.append(ends[-1] + len(before[-1]))
                at, rest = np.repeat(np.arange(len(n)), n), np.concatenate(rests)
                whole = np.repeat([r[0] for r in rests], n)
                nodes = part.column(0).take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([nodes, pa.array(signed(np.concatenate(hs))), pa.array(whole), pa.array(rest), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(signed(np.concatenate(before))))], names=["node", "h", "whole", "rest", "before"])

    return texts.mapInArrow(run, f"node {NODE}, h long, whole double, rest double, before array<long>")


def _remainder(open_: DataFrame, roots: DataFrame, texts: DataFrame, weights, s: Settings, scratch: Scratch) -> DataFrame:
    """(a, b): all pairs of the nodes of ``open_``, of different classes, that can reach the threshold."""
    rows = _prefixes(texts.join(open_, "node", "left_semi"), weights, s).join(roots, "node")
    rows = scratch.save(rows, "prefixes")
    mixed = rows.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("h")
    rows = scratch.save(rows.join(mixed, "h", "left_semi"), "prefixes-mixed")
    scratch.drop("prefixes")
    t = s.similarity
    side = lambda c: rows.select("h", *[F.col(n).alias(f"{n}_{c}") for n in ("node", "root", "whole", "rest", "before")])
    light = side("y").where(F.col("rest_y") >= (2 * t / (1 + t) - EPS) * F.col("whole_y"))
    least = (t / (1 + t) - EPS) * (F.col("whole_x") + F.col("whole_y"))
    fits = F.expr("whole_y < whole_x OR (whole_y = whole_x AND node_y < node_x)") & (F.least("rest_x", "rest_y") >= least)
    fits &= (F.col("whole_y") >= (t - EPS) * F.col("whole_x")) & (F.col("root_x") != F.col("root_y"))
    fits &= ~F.arrays_overlap("before_x", "before_y")  # else the pair is found by an earlier shingle, where these bounds hold as well
    found = side("x").join(light, "h").where(fits)
    return found.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct()


def _verified(pairs: DataFrame, texts: DataFrame, weights, s: Settings) -> DataFrame:
    """The (a, b) whose exact similarity reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, idf_of, memo = ByteHasher(), weights.value, {}

        def of(node: tuple, text: str):
            if node not in memo:
                if len(memo) > 64:
                    memo.clear()
                h, tf = shingles(hasher, text, s.words)
                memo[node] = h, tf * idf_of[(h & U64(s.buckets - 1)).astype(np.int64)]
            return memo[node]

        for batch in batches:
            keep = []
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                a, b, ta, tb = (part.column(i).to_pylist() for i in range(4))
                keep += [weighted_jaccard(of(tuple(x.values()), tx), of(tuple(y.values()), ty)) >= s.similarity for x, y, tx, ty in zip(a, b, ta, tb, strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    t = lambda c: texts.select(F.col("node").alias(c), F.col("text").alias(f"text{c}"))
    return pairs.join(t("a"), "a").join(t("b"), "b").select("a", "b", "texta", "textb").mapInArrow(run, f"a {NODE}, b {NODE}")


def classes(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", s: Settings = Settings()) -> DataFrame:
    """(t1, t2, first): for every text, by its key, the earliest document of its class as (last, id, k1, k2)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    k, t = row_keys(F.col("id"), F.col("text")), [c.alias(n) for c, n in zip(row_keys(F.col("text")), ("t1", "t2"), strict=True)]
    weights = spark.sparkContext.broadcast(idf_table(rows.select("text"), s))  # of a fixed size
    firsts = rows.select(*t, F.struct(F.col("id").isNull().alias("last"), "id", *k).alias("first")).groupBy("t1", "t2").agg(F.min("first").alias("first"))
    firsts = scratch.save(firsts, "firsts")
    sigs = _signatures(rows.select(*t, "text"), weights, s).dropDuplicates(["t1", "t2"])
    sigs = scratch.save(sigs.select(F.struct("t1", "t2").alias("node"), "sig", "bands"), "sigs")
    members = sigs.select("node", F.explode("bands").alias("key"))
    shared = members.groupBy("key").count().where("count > 1").select("key")
    members = scratch.save(members.join(shared, "key", "left_semi"), "members")
    nodes = members.select("node").distinct()
    texts = rows.select(*t, "text").join(nodes.select("node.t1", "node.t2"), ["t1", "t2"], "left_semi").dropDuplicates(["t1", "t2"])
    texts = scratch.save(texts.select(F.struct("t1", "t2").alias("node"), "text"), "texts")

    roots = scratch.save(nodes.select("node", F.col("node").alias("root")), "roots-0")
    tried, step = None, 0

    def root(c: str) -> DataFrame:
        return roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))

    linked = True
    for turn in range(s.rounds + 1):
        last = turn == s.rounds
        if not (linked or last):  # further heads are of no use: the rest is for the exact remainder
            continue
        if last:
            mixed = members.join(roots, "node").groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
            open_ = members.join(mixed, "key", "left_semi").select("node").distinct()
            pairs = _remainder(open_, roots, texts, weights, s, scratch)
        else:
            pairs = _candidates(members, roots, turn)
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = scratch.save(_estimated(pairs, sigs, roots, s), f"pairs-{turn}")
        tried = pairs.select("a", "b") if tried is None else tried.unionByName(pairs.select("a", "b"))
        linked, found = False, None
        for wide in (False, True):  # each text's best candidate in another class first, then all that still join two classes
            step += 1
            apart = pairs.where("ra <> rb").select("a", "b", "est")
            if not wide:
                best = Window.partitionBy("b").orderBy(F.desc("est"), "a")
                apart = apart.withColumn("k", F.row_number().over(best)).where("k = 1")
            elif linked:
                apart = apart.join(found, ["a", "b"], "left_anti")
            found = scratch.save(_verified(apart.select("a", "b"), texts, weights, s), f"links-{step}")
            if found.isEmpty():
                continue
            linked = True
            ends = found.join(root("a"), "a").join(root("b"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
            merged = components(ends, scratch, f"merge-{step}").select(F.col("node").alias("root"), F.col("root").alias("upper"))
            merged = scratch.save(merged, f"merged-{step}")
            for c in ("ra", "rb"):
                pairs = pairs.join(merged.select(F.col("root").alias(c), "upper"), c, "left").withColumn(c, F.coalesce("upper", c)).drop("upper")
            roots = scratch.save(roots.join(merged, "root", "left").select("node", F.coalesce("upper", "root").alias("root")), f"roots-{step}")
    of_root = firsts.select(F.struct("t1", "t2").alias("node"), "first").join(roots, "node").groupBy("root").agg(F.min("first").alias("class_first"))
    near = roots.join(of_root, "root").select("node.t1", "node.t2", "class_first")
    found = scratch.save(firsts.join(near, ["t1", "t2"], "left").select("t1", "t2", F.coalesce("class_first", "first").alias("first")), "classes")
    scratch.keep("classes")
    return found


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", s: Settings = Settings()) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, that stay: one of each class."""
    found = classes(docs, Scratch(docs.sparkSession, "near"), key, text, s)
    stay = found.select("first.k1", "first.k2").distinct()
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = {c: names[docs.columns.index(c)] for c in (key, text)}
    rows = docs.toDF(*names).select(*row_keys(F.col(at[key]).cast("long"), F.col(at[text]).cast("string")), "*").join(stay, ["k1", "k2"])
    once = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("k1"))
    return rows.withColumn("_copy", once).where("_copy = 1").select(*names).toDF(*docs.columns)


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document: doc_id, class_id (the doc_id that stays) and whether it is the row that stays."""
    docs = table(spark, sf_dir, "documents")
    found = classes(docs, Scratch(spark, "near"))
    rows = docs.select("doc_id", *row_keys(F.col("doc_id").cast("long"), F.col("text")), *[c.alias(n) for c, n in zip(row_keys(F.col("text")), ("t1", "t2"), strict=True)])
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy("k1", "k2").orderBy("k1")))
    stays = (F.col("copy") == 1) & (F.col("k1") == F.col("first.k1")) & (F.col("k2") == F.col("first.k2"))
    return rows.join(found, ["t1", "t2"]).select("doc_id", F.col("first.id").alias("class_id"), stays.alias("kept"))
