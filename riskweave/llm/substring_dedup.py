"""Substring dedup: a de Bruijn graph of token k-mers, compacted.

Nodes are sequences of ``K`` - 1 words, named by 64-bit hashes. A window of ``K`` words is an edge from its first to its
last ``K`` - 1 words. All words have numbers that follow the order of the corpus; the number of a window's first word is
its coordinate, and the least coordinate of an edge's occurrences is the edge's source. Edges that occur twice or more
make the graph.

A node with one edge in and one edge out does not branch: its two edges follow each other on a path. Where the sources
of both are side by side, they are one segment, a stretch of a source document; segments that follow each other across
documents are joined to paths by pointer doubling. Along a document, later occurrences of a segment's edges, one after
another, are a span. The words of every segment are read once at its source, and a span goes only if its words are
those of the segment: a collision of hashes removes nothing.

Words of spans that also start earlier (smaller doc_id, or the same document further up) go. Only windows that share a
minimiser with another one become edges (see ``repeats``), and equal texts are one text: a later copy goes whole if it
has a window at all. Rows that share a doc_id but not the text are ordered by content; rows equal in both count as one
document. A null doc_id comes last. Null and empty texts have no words. Empty tables give empty tables.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, U64, WORD_GAP, ByteHasher, Scratch, as_bytes, signed, table, window_hashes, word_bounds
from .mixing import n_words
from .repeats import minimisers, shared_places

K = 20
GRAM = 10  # words of a minimiser
ROWS = 1 << 16  # of a batch of edges
SPAN = "array<struct<start:int,length:int,source:bigint,source_start:int,path:bigint,path_start:bigint>>"


def _grams():
    hasher = ByteHasher()

    def of(text: str | None) -> np.ndarray:
        data = np.frombuffer(as_bytes(text), np.uint8)
        start, end = word_bounds(data)
        return window_hashes(hasher.ranges(hasher.prefix(data), start, end), GRAM)

    return of


def edges(texts: DataFrame, k: int = K, bits: int = 64) -> DataFrame:
    """(a, b, at, ord): the k-mers of (ord, text, shared) whose minimiser is shared, from node a to node b, at their coordinates.

    ``bits`` of a node's hash count (fewer only in tests of collisions).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = ByteHasher()

        def flush(held: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names=["a", "b", "at", "ord"])

        for batch in batches:
            held, size = [], 0
            for text, shared, place in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(0).to_pylist(), strict=True):
                data = np.frombuffer(as_bytes(text), np.uint8)
                start, end = word_bounds(data)
                if len(start) < k:
                    continue
                h = hasher.ranges(hasher.prefix(data), start, end)
                low = minimisers(window_hashes(h, GRAM), k - GRAM + 1)
                known = np.sort(shared.values.field("m").to_numpy().view(U64))
                at = np.minimum(np.searchsorted(known, low), len(known) - 1)
                pos = np.flatnonzero(known[at] == low)
                if not len(pos):
                    continue
                node = signed(window_hashes(h, k - 1)) if bits == 64 else signed(window_hashes(h, k - 1) >> U64(64 - bits) if bits else h * U64(0))
                held.append([node[pos], node[pos + 1], place + pos, np.full(len(pos), place, np.int64)])
                size += len(pos)
                if size >= ROWS:
                    yield flush(held)
                    held, size = [], 0
            if held:
                yield flush(held)

    return texts.select("ord", "text", "shared").mapInArrow(run, "a long, b long, at long, ord long")


def chains(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(head, path, off) of (head, before, n): for every head that follows another one, the first head of its path and how far on it is.

    Pointers double; on a path with a first head fewer of them move in every round. A path that closes on itself has no
    first head, its pointers move for ever: once as many move as in the round before, its heads are left on their own.
    """
    held = scratch.save(links.select("head", F.col("before").alias("path"), F.col("n").alias("off")), "chains-0")
    turn, before, moving = 0, -1, held.count()
    while moving not in (0, before):
        turn += 1
        up = held.select(F.col("head").alias("path"), F.col("path").alias("upper"), F.col("off").alias("more"))
        joined = held.join(up, "path", "left").select("head", F.coalesce("upper", "path").alias("path"), (F.col("off") + F.coalesce("more", F.lit(0))).alias("off"), F.col("upper").isNotNull().alias("moved"))
        held = scratch.save(joined, f"chains-{turn}")
        scratch.drop(f"chains-{turn - 1}")
        before, moving = moving, held.where("moved").count()
    closed = held.select(F.col("head").alias("path"), F.lit(True).alias("closed"))
    held = held.join(closed, "path", "left")
    own = F.coalesce("closed", F.lit(False))
    return held.select("head", F.when(own, F.col("head")).otherwise(F.col("path")).alias("path"), F.when(own, F.lit(0)).otherwise(F.col("off")).alias("off"))


def compact(found: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(segmented, segments) of the edges that occur twice or more.

    ``segmented``: a, b, s (the edge's source), head (the first edge's source of its segment). ``segments``: head, source
    (the document), n (edges), path, off (where on the path the segment begins).
    """
    repeated = found.groupBy("a", "b").agg(F.min("at").alias("s"), F.min("ord").alias("source"), F.count("*").alias("n")).where("n > 1").drop("n")
    repeated = scratch.save(repeated, "repeated")
    none = F.lit(None).cast("long")
    ends = repeated.select(F.col("b").alias("node"), F.col("s").alias("into"), none.alias("out")).unionByName(repeated.select(F.col("a").alias("node"), none.alias("into"), F.col("s").alias("out")))
    nodes = ends.groupBy("node").agg(F.count("into").alias("ins"), F.count("out").alias("outs"), F.min("into").alias("into"), F.min("out").alias("out"))
    links = scratch.save(nodes.where("ins = 1 AND outs = 1 AND into <> out").select("into", "out"), "links")

    along = links.where("out = into + 1").select(F.col("out").alias("s"), F.lit(True).alias("along"))
    of_source = Window.partitionBy("source").orderBy("s").rowsBetween(Window.unboundedPreceding, 0)  # a document's edges
    head = F.last(F.when(F.col("along").isNull(), F.col("s")), ignorenulls=True).over(of_source)
    segmented = scratch.save(repeated.join(along, "s", "left").select("a", "b", "s", "source", head.alias("head")), "segmented")
    scratch.drop("repeated")
    sizes = segmented.groupBy("head").agg(F.min("source").alias("source"), F.count("*").alias("n"))
    sizes = scratch.save(sizes, "sizes")
    across = links.where("out <> into + 1").join(segmented.select(F.col("s").alias("into"), F.col("head").alias("before")), "into")
    across = across.select(F.col("out").alias("head"), "before").join(sizes.select(F.col("head").alias("before"), "n"), "before")
    paths = chains(across, scratch)
    segments = sizes.join(paths, "head", "left").select("head", "source", "n", F.coalesce("path", "head").alias("path"), F.coalesce("off", F.lit(0)).cast("long").alias("off"))
    return segmented, scratch.save(segments, "segments")


def _spans(k: int):
    """From (ord, es): an occurrence's coordinate, its edge's source and segment: the maximal runs along one segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["ord", "start", "length", "head", "off"]
        for batch in batches:
            lists = batch.column(1)
            at, s, head = (lists.flatten().field(c).to_numpy() for c in ("at", "s", "head"))
            of = np.repeat(batch.column(0).to_numpy(), np.diff(lists.offsets.to_numpy()))
            o = np.argsort(at, kind="stable")  # coordinates of different documents do not touch
            at, s, head, of = at[o], s[o], head[o], of[o]
            new = np.flatnonzero(np.concatenate(([True], (np.diff(at) != 1) | (np.diff(s) != 1) | (np.diff(head) != 0)))) if len(at) else at
            length = np.diff(np.append(new, len(at))) + k - 1
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (of[new], (at - of)[new].astype(np.int32), length.astype(np.int32), head[new], (s - head)[new])], names=names)

    return run


def _segment_words(k: int):
    """(head, path, off, source, words) from (ord, text, segments of this source): the words of each segment, joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, text, segments in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = as_bytes(text).split()
                body = [b" ".join(words[x["head"] - place : x["head"] - place + x["n"] + k - 1]) for x in segments]
                cols = [pa.array([x[c] for x in segments], pa.int64()) for c in ("head", "path", "off")]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([place] * len(body), pa.int64()), pa.array(body, pa.binary())], names=["head", "path", "path_off", "source", "words"])

    return run


def _digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ord, start, length, source, source_start, path, path_start, digest): spans with the digest of the words at their source."""
    known, words = None, []
    for batch in batches:
        digests = []
        for low in range(0, batch.num_rows, 256):
            part = batch.slice(low, 256)
            for head, off, length, body in zip(part.column(3).to_pylist(), part.column(4).to_pylist(), part.column(2).to_pylist(), part.column(8), strict=True):
                if head != known:  # rows of a segment come one after another
                    known, words = head, body.as_py().split(b" ")
                digests.append(_digest(words[off : off + length]))
        off = batch.column(4).to_numpy()
        source_start = batch.column(3).to_numpy() + off - batch.column(7).to_numpy()
        columns = [*batch.columns[:3], batch.column(7), pa.array(source_start.astype(np.int32)), batch.column(5), pa.array(batch.column(6).to_numpy() + off), pa.array(digests, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["ord", "start", "length", "source", "source_start", "path", "path_start", "digest"])


def covered(spans: list, n: int) -> np.ndarray:
    """Whether each of ``n`` words is in a span."""
    step = np.zeros(n + 1, np.int64)
    for s in spans:
        step[s["start"]] += 1
        step[s["start"] + s["length"]] -= 1
    return np.cumsum(step[:-1]) > 0


def repeated_spans(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", k: int = K, bits: int = 64):
    """(places, changed): ``changed`` has ord, spans, n_removed and kept (the words left, joined by one space) of every
    first text that loses words; later copies of a text (``places.rows`` without ``first``) lose all words if they have ``k``."""
    extra = {"n_words": n_words(F.col("text")), "whole": F.sha2(F.regexp_replace(F.trim(F.coalesce(F.col("text"), F.lit("")), F.lit(SPACE)), WORD_GAP, " "), 256)}
    places = shared_places(docs, scratch, _grams, k - GRAM + 1, key, text, extra, "n_words")
    found = scratch.save(edges(places.texts, k, bits), "edges")
    segmented, segments = compact(found, scratch)
    later = found.join(segmented.select("a", "b", "s", "head"), ["a", "b"]).where("at <> s").select("ord", F.struct("at", "s", "head").alias("e"))
    # a document's edges are at most as many as its words
    spans = later.groupBy("ord").agg(F.collect_list("e").alias("es")).mapInArrow(_spans(k), "ord long, start int, length int, head long, off long")
    spans = scratch.save(spans, "spans")
    scratch.drop("edges")
    scratch.drop("segmented")
    texts = places.texts.select("ord", "text")
    sources = segments.groupBy(F.col("source").alias("ord")).agg(F.collect_list(F.struct("head", "n", "path", "off")).alias("segments"))
    words = texts.join(sources, "ord").select("ord", "text", "segments").mapInArrow(_segment_words(k), "head long, path long, path_off long, source long, words binary")
    words = scratch.save(words, "words")
    asked = spans.join(words, "head").select("ord", "start", "length", "head", "off", "path", "path_off", "source", "words")
    kinds = "ord long, start int, length int, source long, source_start int, path long, path_start long, digest binary"
    asked = asked.mapInArrow(_asked, kinds).groupBy("ord").agg(F.collect_list(F.struct("start", "length", "source", "source_start", "path", "path_start", "digest")).alias("asked"))
    asked = scratch.save(asked, "asked")
    scratch.drop("words")
    scratch.drop("spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, n, spans = [], [], []
            for text, asked in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = as_bytes(text).split()
                same = [x for x in asked if _digest(words[x["start"] : x["start"] + x["length"]]) == x["digest"]]
                gone = covered(same, len(words))
                kept.append(b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g).decode("utf-8", "surrogatepass"))
                n.append(int(gone.sum()))
                spans.append([{c: v for c, v in x.items() if c != "digest"} for x in sorted(same, key=lambda x: x["start"])])
            lists = pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("source", pa.int64()), ("source_start", pa.int32()), ("path", pa.int64()), ("path_start", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string()), pa.array(n, pa.int64()), lists], names=["ord", "kept", "n_removed", "spans"])

    changed = texts.join(asked, "ord").select("ord", "text", "asked").mapInArrow(cut, f"ord long, kept string, n_removed long, spans {SPAN}")
    return places, changed


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    places, changed = repeated_spans(table(spark, sf_dir, "documents"), Scratch(spark, "substrings"))
    changed = changed.select("ord", "n_removed", F.sha2("kept", 256).alias("kept"))
    rows = places.rows.join(changed, "ord", "left")
    copy = ~F.col("first") & (F.col("n_words") >= K)
    n_removed = F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long")
    kept = F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", "whole"))
    return rows.select(F.col("id").alias("doc_id"), "n_words", n_removed.alias("n_removed"), kept.alias("kept_sha256"))
