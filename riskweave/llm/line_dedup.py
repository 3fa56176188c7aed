"""Line dedup: lines equal to, or within one word edit of, an earlier line are removed.

Equal lines are found by a 128-bit hash. Near ones by a deletion neighbourhood: a line emits a hashed key for itself and
for every deletion of a word. Lines of one length that agree without their i-th word differ in one word; a line that
equals another without some word lacks one. The earliest line of each key meets the others in a join, the edit distance
of each such pair is verified on the words, and the earlier line stays.

The edit bound is one word in ``WORDS_AN_EDIT`` of the shorter line, one at most: a line of fewer words has a bound of 0 and goes as an
exact copy only (with a bound of 1, any line of one word would be near any other).

Only lines that can have a partner emit their deletions: two lines within one word edit share their first or their last
(N - 1) / 2 words, N being the longer one's length, so lines whose both halves are unique are left out without loss.

Every line has a number that follows the order of the corpus: smaller doc_id (null last), then line number; rows with
one doc_id go by their content. A line goes if any earlier line is within the bound, removed itself or not. Lines
without words always stay. Null texts have no lines. Rows that are equal in id and text share one fate: among
themselves they are one document. Empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, ByteHasher, Scratch, as_bytes, mix64, numbered, row_keys, signed, table, word_bounds

WORDS_AN_EDIT = 4
_BASE = 0xD1342543DE82EF95 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, U64)
    p[:1] = 1
    return np.cumprod(p, dtype=U64)


class LineHasher:
    """Hashes of word ranges of a text, from prefix sums over its words' hashes."""

    def __init__(self, seed: int):
        self.bytes = ByteHasher(seed)
        self.up = self.down = np.ones(0, U64)

    def words(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self.bytes.ranges(self.bytes.prefix(data), start, end)

    def prefix(self, h: np.ndarray) -> np.ndarray:
        if len(self.up) <= len(h):
            n = max(1 << 14, 2 * len(h) + 2)
            self.up, self.down = _powers(_BASE, n), _powers(_INVERSE, n)
        s = np.zeros(len(h) + 1, U64)
        np.cumsum(h * self.up[: len(h)], out=s[1:])
        return s

    def range(self, s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Not yet mixed: sums of these, shifted by powers, are hashes of joined ranges."""
        return (s[b] - s[a]) * self.down[a]


def _line_words(data: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each line, its first word and the word after its last."""
    newline = np.flatnonzero(data == 10)
    edges = np.searchsorted(start, np.concatenate(([0], newline + 1, [len(data) + 1])))
    return edges[:-1], edges[1:]


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each text, its lines with words: number, hash and the four hashed halves by which a partner can be found (0: none)."""
    hasher = LineHasher(11)
    names = ["k1", "k2", "doc_id", "n_lines", "lines"]
    parts = ["line", "h1", "h2", "a", "b", "c", "d"]
    for batch in batches:
        cols: list[list[np.ndarray]] = [[] for _ in parts]
        ends, n_lines = [0], []
        for text in batch.column(3).to_pylist():
            data = np.frombuffer(as_bytes(text), np.uint8)
            start, end = word_bounds(data)
            first, last = _line_words(data, start)
            keep = np.flatnonzero(last > first)
            a, b = first[keep], last[keep]
            n = b - a
            words = hasher.words(data, start, end)
            s1, s2 = hasher.prefix(words), hasher.prefix(mix64(words + U64(12)))
            found = [keep.astype(np.int32), signed(mix64(hasher.range(s1, a, b) + n.astype(U64))), signed(mix64(hasher.range(s2, a, b) + n.astype(U64)))]
            for longer in (n, n + 1):  # a partner is as long or shorter; or it is the longer one
                part = longer // 2  # ceil((longer - 1) / 2)
                tag = longer.astype(U64) << U64(2)
                for half in (mix64(mix64(hasher.range(s1, a, a + part)) + tag), mix64(mix64(hasher.range(s1, b - part, b)) + tag + U64(1))):
                    found.append(signed(np.where(n >= WORDS_AN_EDIT, np.maximum(half, U64(1)), U64(0))))
            for col, x in zip(cols, found, strict=True):
                col.append(x)
            ends.append(ends[-1] + len(keep))
            n_lines.append(len(first))
        values = pa.StructArray.from_arrays([pa.array(np.concatenate(c) if c else np.zeros(0, np.int64)) for c in cols], parts)
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n_lines, pa.int64()), lists], names=names)


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, kind, gid) of lines (gid, body): the keys of a line itself (1) and of every deletion of one word (2, 3).

    The same-length key of a deletion (3) holds its place and the line's length; the shorter-line key (2) does not.
    """
    hasher = LineHasher(13)
    for batch in batches:
        gids, keys, kinds = [], [], []
        for gid, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            data = np.frombuffer(as_bytes(body), np.uint8)
            s = hasher.prefix(hasher.words(data, *word_bounds(data)))
            n = len(s) - 1
            at = np.arange(n)
            cut = mix64(s[:-1] + (s[n] - s[1:]) * U64(_INVERSE) + U64(n - 1))
            place = mix64(cut + (U64(n) << U64(32)) + (at + 1).astype(U64))
            cut = np.unique(cut)  # the same word twice in a row
            keys += [mix64(s[n:] + U64(n)), cut, place]
            kinds.append(np.repeat(np.array([1, 2, 3], np.int8), (1, len(cut), n)))
            gids.append(np.full(1 + len(cut) + n, gid, np.int64))
        if gids:
            yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(keys))), pa.array(np.concatenate(kinds)), pa.array(np.concatenate(gids))], names=["key", "kind", "gid"])


def within_one(a: list[str], b: list[str]) -> bool:
    """Whether the word edit distance is at most 1."""
    if abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gid, e) of (gid, e, body, other) within the bound."""
    for batch in batches:
        keep = [within_one(as_bytes(x).split(), as_bytes(y).split()) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["gid", "e"]).filter(pa.array(keep, pa.bool_()))


def find(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(k1, k2, removed): for every document with lines to remove, by its row key, their numbers (from 0)."""
    rows = docs.select(*row_keys(F.col(key), F.col(text)), F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    kinds = ", ".join(f"{c}: bigint" for c in ("h1", "h2", "a", "b", "c", "d"))
    scanned = rows.mapInArrow(_lines, f"k1 long, k2 long, doc_id long, n_lines long, lines array<struct<line: int, {kinds}>>")
    scanned = scratch.save(scanned.where(F.size("lines") > 0), "scanned")
    order = scanned.groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"), F.max("n_lines").alias("n_lines"))
    order = scratch.save(numbered(order, [F.col("doc_id").asc_nulls_last(), "k1", "k2"], F.col("n_lines"), "k1", "k2"), "order")
    lines = scanned.join(order, ["k1", "k2"]).select("base", F.explode("lines").alias("l")).select("base", "l.*")
    lines = scratch.save(lines.withColumn("gid", F.col("base") + F.col("line")).drop("line"), "lines")
    scratch.drop("scanned")
    firsts = lines.groupBy("h1", "h2").agg(*[F.min(c).alias(c) for c in ("gid", "base", "a", "b", "c", "d")], F.max("gid").alias("last"))
    firsts = scratch.save(firsts, "firsts")

    halves = firsts.select("gid", "base", F.explode(F.array("a", "b", "c", "d")).alias("half")).where("half <> 0")
    shared = halves.groupBy("half").agg(F.count("*").alias("n")).where("n > 1").select("half")
    maybe = scratch.save(halves.join(shared, "half", "left_semi").select("gid", "base").distinct(), "maybe")

    asked = maybe.groupBy("base").agg(F.collect_list("gid").alias("gids")).join(order, "base")  # of one document
    texts = rows.select("k1", "k2", F.split("text", "\n").alias("parts")).join(asked, ["k1", "k2"])  # a repeated row gives its lines again, to the same end
    bodies = texts.select("parts", "base", F.explode("gids").alias("gid")).select("gid", F.expr("parts[int(gid - base)]").alias("body"))
    bodies = scratch.save(bodies.dropDuplicates(["gid"]), "bodies")
    scratch.drop("maybe")
    variants = scratch.save(bodies.mapInArrow(_variants, "key long, kind byte, gid long"), "variants")
    whole, cut, same = (F.min(F.when(F.col("kind") == k, F.col("gid"))).alias(c) for k, c in ((1, "whole"), (2, "cut"), (3, "same")))
    least = variants.groupBy("key").agg(whole, cut, same, F.count("*").alias("n")).where("n > 1").drop("n")
    earliest = F.when(F.col("kind") == 1, F.col("cut")).when(F.col("kind") == 2, F.col("whole")).otherwise(F.col("same"))
    pairs = variants.join(least, "key").select("gid", earliest.alias("e")).where("e < gid").distinct()
    pairs = scratch.save(pairs, "pairs")
    scratch.drop("variants")

    other = bodies.select(F.col("gid").alias("e"), F.col("body").alias("other"))
    near = pairs.join(bodies, "gid").join(other, "e").select("gid", "e", "body", "other").mapInArrow(_verified, "gid long, e long")
    near = scratch.save(near.select("gid").distinct().withColumn("near", F.lit(True)), "near")
    scratch.drop("bodies")
    decided = firsts.select("h1", "h2", "gid", "last").join(near, "gid", "left").where("near OR gid < last").select("h1", "h2", F.when(~F.coalesce("near", F.lit(False)), F.col("gid")).alias("stays"))
    gone = lines.select("h1", "h2", "base", "gid").join(decided, ["h1", "h2"]).where("stays IS NULL OR stays < gid")
    gone = gone.groupBy("base").agg(F.sort_array(F.collect_set((F.col("gid") - F.col("base")).cast("int"))).alias("removed"))
    removed = scratch.save(gone.join(order, "base").select("k1", "k2", "removed"), "removed")
    scratch.keep("removed")
    return removed


def without_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs``, all columns kept, without the removed lines; documents that lose all their words go. ``n_chars``, if there, is counted anew."""
    removed = find(docs, Scratch(docs.sparkSession, "lines"), key, text)
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = {c: names[docs.columns.index(c)] for c in (key, text)}
    rows = docs.toDF(*names).select(*row_keys(F.col(at[key]), F.col(at[text])), "*").join(removed, ["k1", "k2"], "left").select(*names, "removed")
    place = names.index(at[text])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).to_pylist()
            keep = []
            for i, gone in enumerate(batch.column(len(names)).to_pylist()):
                if gone:
                    gone = set(gone)
                    texts[i] = "\n".join(x for j, x in enumerate(texts[i].split("\n")) if j not in gone)
                keep.append(not gone or bool(texts[i].encode().split()))
            columns = list(batch.columns[: len(names)])
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep, pa.bool_()))

    schema = ", ".join(f"{n} {t}" for n, t in docs.toDF(*names).dtypes)
    out = rows.mapInArrow(cut, schema).toDF(*docs.columns)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(text).cast(dict(docs.dtypes)["n_chars"]))
    return out


def n_lines(text: Column) -> Column:
    return F.coalesce(F.size(F.split(text, "\n", -1)), F.lit(0)).cast("long")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document: doc_id, its lines, how many go, and their numbers."""
    docs = table(spark, sf_dir, "documents")
    removed = find(docs, Scratch(spark, "lines"))
    rows = docs.select(*row_keys(F.col("doc_id"), F.col("text")), "doc_id", F.when(F.col("text").isNull(), 0).otherwise(n_lines(F.col("text"))).alias("n_lines"))
    out = rows.join(removed, ["k1", "k2"], "left")
    return out.select("doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))
