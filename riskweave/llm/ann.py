"""Approximate nearest neighbours by largest inner product: balanced posting lists.

Vectors are brought to equal length by one more coordinate, so that the largest inner product is the smallest distance.
Centroids come from balanced k-means over a bounded sample. Every vector goes to the list of its nearest centroid and,
when it lies near a boundary, to further lists whose centroids are hardly farther and not close to a list it is in.
Centroids are searched by an in-memory graph; a query visits all centroids found within a ratio of its
nearest one, and at least as many as give a bounded sample of the queries, held against all rows, the recall asked for. Lists longer than a bound are cut into chunks, and lists of near centroids are packed into shards of a
bounded number of vectors, so that no task holds more; a query visits all shards that have chunks of its lists. Each shard
gives a query its best candidates, scored exactly, in double precision, component after component; the queries that visit a
shard are dealt over slices of a bounded number. Queries that find fewer than they ask for meet all rows, block by block.

Vectors that are null, empty, zero, of another length than most, or hold null or non-finite components take no part.
Rows with equal ids count as one candidate, with the better score. Ties go to the smaller id. Fewer candidates than asked for give
all of them; empty tables give an empty result. Components of any finite size are taken: lists are made of vectors over the
largest component of all, and a score beyond double precision is infinite, with the sign of the exact one.
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import copy
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import blocks
from .common import Scratch, table


#: Candidates that a task holds before it reduces them to the best.
HELD = 2_000_000


@dataclass(frozen=True)
class Settings:
    sample: int = 20_000  # vectors that the centroids are fitted on, at most
    list_size: int = 400  # vectors a list, about
    max_lists: int = 4096
    replicas: int = 4  # lists a vector is in, at most
    boundary: float = 1.08  # a further list's distance against the nearest
    ratio: float = 1.25  # a visited list's distance against a query's nearest
    least: int = 32  # lists that a query visits, at least (all, if there are fewer); more if the probes need them
    probes: int = 256  # queries that are held against all rows, at most
    recall: float = 0.98  # of the probes
    queries: int = 20_000  # queries that meet a shard in one task, about
    degree: int = 24  # neighbours of a centroid in the graph
    beam: int = 96  # centroids kept in a search, at least; a query keeps all within the ratio
    chunk: int = 16_384  # vectors of a list in one shard, about
    shard: int = 32_768  # vectors that one task scores at once, about
    seed: int = 5


def balanced_kmeans(x: np.ndarray, k: int, seed: int, steps: int = 12) -> np.ndarray:
    """Centroids whose clusters are of similar size: a full cluster's distance is raised for the next round."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    penalty = np.zeros(k)
    for _ in range(steps):
        d = (c * c).sum(1)[None, :] - 2 * x @ c.T + penalty[None, :]
        own = d.argmin(1)
        n = np.bincount(own, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        full = n > 0
        c[full] = sums[full] / n[full, None]
        if (~full).any():
            c[~full] = x[rng.choice(len(x), int((~full).sum()), replace=False)]
        penalty += 0.02 * np.abs(d.min(1)).mean() * (n / max(1.0, n.mean()) - 1)
        penalty -= penalty.mean()
    return c


class CentroidGraph:
    """Centroids with links to near ones, searched best-first from several entries."""

    def __init__(self, centroids: np.ndarray, degree: int, beam: int):
        self.c = centroids
        k = len(centroids)
        d = self._far(centroids, np.arange(k))
        np.fill_diagonal(d, np.inf)
        near = np.argsort(d, axis=1)[:, : min(degree, max(0, k - 1))]
        links = [set(r) for r in near.tolist()]
        for i, r in enumerate(near.tolist()):  # links go both ways
            for j in r[: degree // 2]:
                links[j].add(i)
        ring = np.argsort(centroids[:, 0], kind="stable").tolist()  # and none is without a way to it
        for i, j in zip(ring, ring[1:] + ring[:1], strict=True):
            links[i].add(j)
        self.links = [np.array(sorted(s), np.int64) for s in links]
        self.entries = np.unique(np.linspace(0, k - 1, min(k, 16)).astype(np.int64))
        self.beam = beam

    def _far(self, x: np.ndarray, which: np.ndarray) -> np.ndarray:
        c = self.c[which]
        return np.maximum(0, (x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * x @ c.T)

    def search(self, x: np.ndarray, ratio: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Centroids near one vector and their squared distances, nearest first: the beam's, and all found within ``ratio`` of the nearest."""
        seen = np.zeros(len(self.c), bool)
        seen[self.entries] = True
        found, far = self.entries, self._far(x[None], self.entries)[0]
        open_ = np.ones(len(found), bool)
        while open_.any():
            # all unopened members of the beam are opened together
            ring = np.unique(np.concatenate([self.links[i] for i in found[open_]] or [found[:0]]))
            ring = ring[~seen[ring]]
            seen[ring] = True
            d = self._far(x[None], ring)[0] if len(ring) else far[:0]
            found, far = np.concatenate((found, ring)), np.concatenate((far, d))
            open_ = np.concatenate((np.zeros(len(open_), bool), np.ones(len(ring), bool)))
            best = np.argsort(far, kind="stable")
            best = best[: max(self.beam, np.searchsorted(far[best], ratio * ratio * far[best[0]], "right"))]
            found, far, open_ = found[best], far[best], open_[best]
        return found, far


def _matrix(batch: pa.RecordBatch, column: int) -> np.ndarray:
    values = batch.column(column)
    return values.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(values), -1)


def valid(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): the rows whose vectors take part."""
    v = F.col(vector).cast("array<double>")
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), v.alias("v"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0))
    usual = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (usual["n"] if usual else 0))


@dataclass
class Index:
    """``lists``: id, v, list, shard for every vector and list it is in; ``shards``: list -> the shards of its chunks."""

    graph: CentroidGraph
    length: float  # the largest squared length, of vectors over ``largest``
    largest: float  # the largest component
    rows: DataFrame  # id, v
    scratch: Scratch
    lists: DataFrame
    shards: dict[int, list[int]]
    settings: Settings


def pack(sizes: dict[int, int], centroids: np.ndarray, settings: Settings) -> dict[int, list[int]]:
    """list -> shards of its chunks: chunks in the order of the centroids' main direction fill one shard after the other."""
    main = np.linalg.svd(centroids - centroids.mean(0), full_matrices=False)[2][0]
    out: dict[int, list[int]] = {}
    shard, filled = 0, 0
    for j in sorted(sizes, key=lambda j: (centroids[j] @ main, j)):
        n = -(-sizes[j] // settings.chunk)
        for _ in range(n):
            if filled and filled + sizes[j] / n > settings.shard:
                shard, filled = shard + 1, 0
            out.setdefault(j, []).append(shard)
            filled += sizes[j] / n
    return out


def build(rows: DataFrame, scratch: Scratch, settings: Settings = Settings()) -> Index | None:
    """Index every row of (id, v). The centroids, of a bounded number, are fitted by the driver on a bounded sample."""
    total = rows.agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("v", F.abs))).alias("m")).first()
    if not total["n"]:
        return None
    largest = float(total["m"])
    length = float(rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / largest) * (x / largest)))).first()[0])
    pick = F.pmod(F.xxhash64("id", F.lit(settings.seed)), F.lit(1 << 30))
    sample = rows if total["n"] <= settings.sample else rows.where(pick < int((1 << 30) * settings.sample / total["n"]))
    x = np.array([r[0] for r in sample.select("v", pick.alias("p")).orderBy("p").limit(settings.sample).collect()], float) / largest
    x = np.column_stack([x, np.sqrt(np.maximum(0, length - (x * x).sum(1)))])
    k = int(max(1, min(settings.max_lists, total["n"] // settings.list_size, len(x))))
    graph = CentroidGraph(balanced_kmeans(x, k, settings.seed), settings.degree, settings.beam)
    held = rows.sparkSession.sparkContext.broadcast((graph, length, largest, settings))  # bounded by max_lists

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, length, largest, s = held.value
        for batch in batches:
            x = _matrix(batch, 1) / largest
            x = np.column_stack([x, np.sqrt(np.maximum(0, length - (x * x).sum(1)))])
            take, lists = [], []
            for i, row in enumerate(x):
                found, far = graph.search(row)
                far, mine = np.sqrt(far), []
                for j, d in zip(found.tolist(), far.tolist(), strict=True):
                    if d > far[0] * s.boundary or len(mine) >= s.replicas:
                        break
                    # a centroid closer to one that is taken than to the vector would add little
                    if all(np.linalg.norm(graph.c[j] - graph.c[m]) > 0.35 * d for m in mine):
                        mine.append(j)
                take += [i] * len(mine)
                lists += mine
            out = batch.take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(lists, pa.int32())], names=["id", "v", "list"])

    lists = scratch.save(rows.mapInArrow(assign, "id long, v array<double>, list int"), "lists")
    sizes = {r["list"]: r["count"] for r in lists.groupBy("list").count().collect()}  # at most max_lists rows
    shards = pack(sizes, graph.c, settings)
    spark = rows.sparkSession
    table_ = spark.createDataFrame(sorted(shards.items()), "list int, shards array<int>")
    chunk = F.pmod(F.xxhash64("id", F.lit("chunk")), F.size("shards")).cast("int")
    lists = lists.join(F.broadcast(table_), "list").withColumn("shard", F.get("shards", chunk)).drop("shards")
    return Index(graph, length, largest, rows, scratch, lists, shards, settings)


def _truth(index: Index, probes: list[tuple[int, np.ndarray]], k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the probes' true nearest of all rows; each task reduces its rows to the best."""
    held = index.rows.sparkSession.sparkContext.broadcast((np.array([i for i, _ in probes], np.int64), np.stack([v for _, v in probes])))  # bounded by ``probes``

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q = held.value
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for batch in batches:
            if batch.num_rows:
                found = [best_rows([*found, best_of(q, qids, _matrix(batch, 1), batch.column(0).to_numpy(), k)], k)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in found[0]], names=["query_id", "vec_id", "score"])

    return _ranked(index.rows.select("id", "v").mapInArrow(run, "query_id long, vec_id long, score double"), k)


def calibrated(index: Index, queries: DataFrame, k: int) -> Settings:
    """The settings with ``least`` and ``beam`` raised until the probes' recall is as asked; with all lists it is 1."""
    s, lists = index.settings, len(index.graph.c)
    if s.probes <= 0 or s.least >= lists:
        return replace(s, beam=max(s.beam, lists)) if s.probes > 0 else s
    pick = F.xxhash64("id", F.lit(s.seed))
    probes = [(r["id"], np.array(r["v"], float)) for r in queries.select("id", "v").orderBy(pick, "id").limit(s.probes).collect()]
    if not probes:
        return s
    truth = index.scratch.save(_truth(index, probes, k), "truth")
    where = index.lists.select(F.col("id").alias("vec_id"), "list").join(F.broadcast(truth.select("vec_id").distinct()), "vec_id").distinct()  # at most probes * k
    of: dict[int, set[int]] = {}
    for r in where.collect():
        of.setdefault(r["vec_id"], set()).add(r["list"])
    wanted: dict[int, list[int]] = {}
    for r in truth.collect():
        wanted.setdefault(r["query_id"], []).append(r["vec_id"])
    least = s.least
    while least < lists:
        beam = max(s.beam, 2 * least)
        graph, hits = replace_beam(index.graph, beam), 0
        for i, v in probes:
            mine = set(_visited(graph, v, s.ratio, least).tolist())
            hits += sum(not mine.isdisjoint(of.get(j, ())) for j in wanted.get(i, ()))
        if hits >= s.recall * sum(map(len, wanted.values())):
            return replace(s, least=least, beam=beam)
        least *= 2
    return replace(s, least=lists, beam=lists)


def replace_beam(graph: CentroidGraph, beam: int) -> CentroidGraph:
    """The same graph, searched with another beam."""
    other = copy(graph)
    other.beam = beam
    return other


def _visited(graph: CentroidGraph, v: np.ndarray, ratio: float, least: int) -> np.ndarray:
    """The lists that a query visits. Its own length does not change the order: it is compared at the length that the lists have."""
    x = v / np.abs(v).max()
    scale = np.sqrt((graph.c * graph.c).sum(1)).mean() / np.sqrt((x * x).sum())
    found, far = graph.search(np.append(x * scale, 0.0), ratio)
    return found[: max(int((np.sqrt(far) <= ratio * np.sqrt(far[0])).sum()), least)]


def search(index: Index | None, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest among the lists it visits, its own id left out; never fewer than there are."""
    spark = queries.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    if index is None:
        return spark.createDataFrame([], schema)
    settings = calibrated(index, queries, k)
    held = spark.sparkContext.broadcast((replace_beam(index.graph, settings.beam), index.shards, settings))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, shards, s = held.value
        for batch in batches:
            take, where, lists = [], [], []
            for i, row in enumerate(_matrix(batch, 1)):
                mine: dict[int, list[int]] = {}
                for j in _visited(graph, row, s.ratio, s.least).tolist():
                    for p in set(shards.get(j, ())):
                        mine.setdefault(p, []).append(j)
                take += [i] * len(mine)
                where += list(mine)
                lists += list(mine.values())
            out = batch.take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(where, pa.int32()), pa.array(lists, pa.list_(pa.int32()))], names=["id", "v", "shard", "lists"])

    def scan(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        ids, of_list = right["id"].to_numpy(), right["list"].to_numpy()
        x = np.stack(right["v"].to_numpy()).astype(float)
        q, qids = np.stack(left["v"].to_numpy()).astype(float), left["id"].to_numpy()
        size = dict(zip(*(c.tolist() for c in np.unique(of_list, return_counts=True)), strict=True))
        once = distinct_rows(ids, x)
        # a query whose lists hold about as many rows as the shard has different ones meets those, without their replicas
        wide = np.array([2 * sum(size.get(int(j), 0) for j in lists) >= len(once) for lists in left["lists"]])
        visits: dict[int, list[int]] = {}
        for i, lists in enumerate(left["lists"]):
            for j in () if wide[i] else lists:
                visits.setdefault(int(j), []).append(i)
        found, held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))], 0
        for low in range(0, int(wide.sum()), 512):
            part = np.flatnonzero(wide)[low : low + 512]
            found.append(best_in_blocks(q[part], qids[part], x[once], ids[once], k))
        for j, who in visits.items():
            rows = np.flatnonzero(of_list == j)
            for low in range(0, len(who), 512):
                part = np.array(who[low : low + 512])
                found.append(best_of(q[part], qids[part], x[rows], ids[rows], k))
                held += len(found[-1][0])
                if held > HELD:
                    found = [best_rows(found, k)]
                    held = 0
        query, vec, score = best_rows(found, k)
        return pd.DataFrame({"query_id": query, "vec_id": vec, "score": score})

    scratch = index.scratch
    visits = scratch.save(queries.mapInArrow(visit, "id long, v array<double>, shard int, lists array<int>"), "visits")
    slices = visits.groupBy("shard").agg(F.ceil(F.count("*") / index.settings.queries).cast("int").alias("slices"))
    visits = visits.join(slices, "shard").withColumn("slice", F.pmod(F.xxhash64("id", F.lit("slice")), F.col("slices")).cast("int")).drop("slices")
    lists = index.lists.join(slices, "shard").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")
    found = visits.groupBy("shard", "slice").cogroup(lists.groupBy("shard", "slice")).applyInPandas(scan, "query_id long, vec_id long, score double")
    found = scratch.save(_ranked(found, k), "found")
    few = found.groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("n")).where(F.col("n") >= k)
    short = scratch.save(queries.select("id").distinct().join(few.select("id"), "id", "left_anti"), "short")
    if short.isEmpty():
        return found
    rest = full_scan(index.rows, queries.join(short, "id"), k, scratch)
    return found.join(short.withColumnRenamed("id", "query_id"), "query_id", "left_anti").unionByName(_ranked(rest, k))


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows of two matrices, pair by pair: one order of addition, so equal vectors get equal scores."""
    score = np.zeros(len(q))
    with np.errstate(over="ignore", invalid="ignore"):
        for d in range(q.shape[1]):
            score += q[:, d] * x[:, d]
    lost = np.flatnonzero(np.isnan(score))  # infinities of both signs: the sign comes from the vectors over their largest components
    for i in lost.tolist():
        sign = np.sign((q[i] / np.abs(q[i]).max()) @ (x[i] / np.abs(x[i]).max()))
        score[i] = sign * np.inf if sign else 0.0
    return score


def best_of(q: np.ndarray, qids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, every: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, score): each query's ``k`` best rows with other ids, ties to smaller ids; rows that share id and score count once."""
    # products of vectors over the largest components, which cannot overflow, choose the pairs that are scored
    qs, xs = q / np.abs(q).max(1, keepdims=True), x / max(np.abs(x).max(initial=0), np.finfo(float).tiny)
    near = qs @ xs.T
    slack = 1e-9 * np.sqrt((qs * qs).sum(1))[:, None] * np.sqrt((xs * xs).sum(1))[None, :] + np.finfo(float).tiny  # far above the rounding of a product
    other = qids[:, None] != ids[None, :]
    sure = np.where(other, near - slack, -np.inf)
    if len(ids) > 4 * k and not every:
        least = np.partition(sure, -4 * k, axis=1)[:, -4 * k]
    else:
        least = np.full(len(q), -np.inf)
    a, b = np.nonzero(other & (near + slack >= least[:, None]))
    score = scores(q[a], x[b])
    order = np.lexsort((ids[b], -score, a))
    a, i, score = a[order], ids[b][order], score[order]
    once = np.concatenate(([True], (a[1:] != a[:-1]) | (i[1:] != i[:-1]) | (score[1:] != score[:-1])))[: len(a)]
    a, i, score = a[once], i[once], score[once]
    best = np.arange(len(a)) - np.searchsorted(a, a) < k
    a, i, score = a[best], i[best], score[best]
    short = np.bincount(a, minlength=len(q)) < k
    if len(ids) > 4 * k and not every and short.any():  # rows that share an id have taken the places: such queries see all rows
        parts = [(qids[a[~short[a]]], i[~short[a]], score[~short[a]])] + [best_of(q[[j]], qids[[j]], x, ids, k, True) for j in np.flatnonzero(short).tolist()]
        return tuple(np.concatenate(c) for c in zip(*parts, strict=True))
    return qids[a], i, score


def distinct_rows(ids: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Places of the rows without replicas: of neighbours with one id and one vector the first."""
    order = np.argsort(ids, kind="stable")
    i, v = ids[order], x[order]
    again = (i[1:] == i[:-1]) & (v[1:] == v[:-1]).all(1)
    return order[np.concatenate(([True], ~again))]


def best_in_blocks(q: np.ndarray, qids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, block: int = 2048) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``best_of`` over blocks of rows: from the second block on a query scores only rows that can reach its ``k``-th best so far."""
    names, own = np.unique(qids, return_inverse=True)
    best = best_of(q, qids, x[:block], ids[:block], k)
    for low in range(block, len(ids), block):
        best = best_rows([best], k)
        place, floor = np.searchsorted(names, best[0]), np.full(len(names), np.inf)
        np.minimum.at(floor, place, best[2])
        floor[np.bincount(place, minlength=len(names)) < k] = -np.inf
        floor, bx, bi = floor[own], x[low : low + block], ids[low : low + block]
        # floors in the measure of products of vectors over their largest components
        longest, most = np.abs(q).max(1), max(np.abs(bx).max(initial=0), np.finfo(float).tiny)
        with np.errstate(over="ignore", invalid="ignore", divide="ignore", under="ignore"):
            unit = longest * most
            least = floor / unit
        known = np.isfinite(floor) & np.isfinite(least) & (unit > 1e-200)
        parts = [best]
        if not known.all():
            parts.append(best_of(q[~known], qids[~known], bx, bi, k))
        if known.any():
            qs, xs = q[known] / longest[known, None], bx / most
            slack = 1e-9 * np.sqrt((qs * qs).sum(1)) * np.sqrt((xs * xs).sum(1)).max() + np.finfo(float).tiny
            a, b = np.nonzero(qs @ xs.T >= (least[known] - slack)[:, None])
            other = qids[known][a] != bi[b]
            a, b = a[other], b[other]
            parts.append((qids[known][a], bi[b], scores(q[known][a], bx[b])))
        best = tuple(np.concatenate(c) for c in zip(*parts, strict=True))
    return best_rows([best], k)


def best_rows(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, score) of several lists as one: each query's ``k`` best, an id counting once, with its better score."""
    query, vec, score = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((-score, vec, query))
    query, vec, score = query[order], vec[order], score[order]
    once = np.concatenate(([True], (query[1:] != query[:-1]) | (vec[1:] != vec[:-1])))[: len(query)]
    query, vec, score = query[once], vec[once], score[once]
    order = np.lexsort((vec, -score, query))
    query, vec, score = query[order], vec[order], score[order]
    best = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[best], vec[best], score[best]


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """A vector in several lists is found more than once; rows that share an id keep the better score."""
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def full_scan(rows: DataFrame, queries: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """(query_id, vec_id, score): candidates of every query from all rows, block by block."""
    shaped = lambda df: df.select("id", F.lit(0).cast("long").alias("label"), F.lit(0).cast("long").alias("row"), "v")
    packed = blocks.pack(shaped(rows), scratch, "blocks", blocks.BLOCK_BYTES)
    slices = blocks.pack(shaped(queries), scratch, "slices", blocks.SLICE_BYTES)

    def run(block: blocks.Part, part: blocks.Part, _: dict) -> Iterator[pa.RecordBatch]:
        columns = best_of(part.x, part.ids, block.x, block.ids, k)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])

    return blocks.against(packed, slices, 0, run, "query_id long, vec_id long, score double", scratch, "scanned")


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = valid(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    index = build(rows, Scratch(spark, "nearest"))
    return search(index, rows.where(F.col("id") % 20 == 0), 20)
