"""Graphs of references: cycles, levels, reachability, roots."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..errors import CycleError


def _store(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = held.get() if held.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that all of them share")
        folder = f"file://{tempfile.mkdtemp(prefix='riskweave-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/graph-{uuid.uuid4().hex}"


#: How many times its compressed file a table takes in memory, for Spark's choice of what to broadcast.
EXPANSION = 32
_FACTOR = "spark.sql.sources.fileCompressionFactor"
#: Files that a task writes at once; rows need no sorting by folder while there are no more.
_WRITERS, WRITERS = "spark.sql.maxConcurrentOutputFileWriters", 16
#: Whether the shuffle files of a statement go when it ends; what is written is read from its files only.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_sizing, _sized = threading.Lock(), {"users": 0, "before": {}}


@contextmanager
def memory_sizes(spark: SparkSession) -> Iterator[None]:
    """While inside, files count with their size in memory: names in models shrink so much in a file that tables of many times the broadcast limit would go through the driver.

    Shuffle files of what is written go at once; else they stay until the driver happens to collect its garbage.
    """
    with _sizing:
        if not _sized["users"]:
            _sized["before"] = {_FACTOR: spark.conf.get(_FACTOR), _WRITERS: spark.conf.get(_WRITERS), _CLEANUP: spark.conf.get(_CLEANUP, "false")}
            spark.conf.set(_CLEANUP, "true")
            spark.conf.set(_FACTOR, str(max(float(_sized["before"][_FACTOR]), EXPANSION)))
            spark.conf.set(_WRITERS, str(max(int(_sized["before"][_WRITERS]), WRITERS)))
        _sized["users"] += 1
    try:
        yield
    finally:
        with _sizing:
            _sized["users"] -= 1
            if not _sized["users"]:
                for name, value in _sized["before"].items():
                    spark.conf.set(name, value)


class Rounds:
    """Tables of a loop, written to the shared folder so that neither lineage nor recomputation grows with the rounds."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.n = spark, _store(spark), 0

    def save(self, df: DataFrame, *parts: str) -> DataFrame:
        """The table as written, by folders of the columns ``parts``. Its rows are counted while they are written, see ``empty``; one without rows is read no more."""
        self.n += 1
        return self._write(df, self.n, *parts)

    def _write(self, df: DataFrame, number: int, *parts: str) -> DataFrame:
        path, seen = f"{self.folder}/{number}", Observation()
        with memory_sizes(self.spark):
            df.observe(seen, F.count(F.lit(1)).alias("rows")).write.partitionBy(*parts).option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        rows = seen.get["rows"]
        out = out if rows else out.where("false")
        out._saved_rows = rows
        return out

    def save_all(self, frames: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """Tables that do not need each other, their jobs at the same time."""
        first, self.n = self.n + 1, self.n + len(frames)
        with ThreadPoolExecutor(8) as pool:
            return dict(zip(frames, pool.map(self._write, frames.values(), range(first, first + len(frames))), strict=True))

    def drop(self, *numbers: int) -> None:
        """Delete tables, by the numbers of their saving, that nothing reads any more."""
        for n in numbers:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{n}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def empty(df: DataFrame) -> bool:
    """Whether a table has no rows; needs no job for one that ``Rounds`` has written."""
    rows = df.__dict__.get("_saved_rows")
    return df.isEmpty() if rows is None else not rows


def same_rows(df: DataFrame, written: DataFrame) -> DataFrame:
    """Columns of a table that ``Rounds`` has written, all its rows kept: known to be written as well."""
    if "_saved_rows" in written.__dict__:
        df._saved_rows = written._saved_rows
    return df


def levels(edges: DataFrame, distinct: bool = False) -> tuple[DataFrame, DataFrame]:
    """(node, level) by longest path from the leaves, and the edges (a, b: a refers to b) that lie on or above a cycle.

    Every round takes the nodes all of whose references are placed. What is never placed refers into a cycle. ``distinct``: no edge comes twice.
    """
    rounds = Rounds(edges.sparkSession)
    left = edges.select("a", "b")
    left = same_rows(left, edges) if distinct and "_saved_rows" in edges.__dict__ else rounds.save(left if distinct else left.distinct())
    if empty(left):
        return left.select(F.col("a").alias("node"), F.lit(0).alias("level")), left
    placed = rounds.save(left.select(F.col("b").alias("node")).join(left.select(F.col("a").alias("node")), "node", "left_anti").distinct().withColumn("level", F.lit(0)))
    front, level, held = placed, 0, []
    while not empty(front):
        level += 1
        # one pass tells what stays open and which nodes lead to the front
        seen = left.join(front.select(F.col("node").alias("b"), F.lit(True).alias("met")), "b", "left")
        seen = rounds.save(seen.select("a", F.when(F.col("met").isNull(), F.col("b")).alias("b"), F.col("met").isNull().alias("open")), "open")
        held.append(rounds.n)
        rest, touched = seen.where("open").select("a", "b"), seen.where("NOT open").select(F.col("a").alias("node")).distinct()
        front = rounds.save(touched.join(rest.select(F.col("a").alias("node")), "node", "left_anti").withColumn("level", F.lit(level)))
        if len(held) > 1:
            rounds.drop(held.pop(0))
        placed, left = placed.unionByName(front), rest
    return placed, left


def only(large: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """The rows of a table whose ``key`` is among that of ``few``: as these may be broadcast, the table need not be dealt out."""
    return large.join(few.select(key).distinct(), key).select(*large.columns)


def on_cycles(edges: DataFrame) -> DataFrame:
    """Edges of the parts that hold cycles: what neither refers to leaves only nor is referred to from roots only."""
    _, up = levels(edges)
    _, down = levels(up.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return down.select(F.col("b").alias("a"), F.col("a").alias("b"))


def some_cycles(edges: DataFrame) -> DataFrame:
    """(path) like ``a->b->a``, from its least node: a cycle for every part of the graph that has any, at least one.

    On what refers into cycles and is referred to from them every node keeps one reference. Pointers along these double
    until all are on cycles; a cycle is named by the least of its nodes, which doubles along.
    """
    rounds = Rounds(edges.sparkSession)
    edges = rounds.save(edges.select("a", "b").distinct())
    none = edges.sparkSession.createDataFrame([], "path string")
    if empty(edges):
        return none
    core = on_cycles(edges).groupBy("a").agg(F.min("b").alias("b"))
    jump = one = rounds.save(core.select("a", "b", F.least("a", "b").alias("least")))
    n = one.count()
    if not n:
        return none
    for _ in range(n.bit_length()):
        far = jump.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("least").alias("further"))
        jump = rounds.save(jump.join(far, "b").select("a", F.col("c").alias("b"), F.least("least", "further").alias("least")))
    ends = jump.select("b").distinct().withColumnRenamed("b", "a")  # all on cycles
    steps = one.select("a", "b").join(ends, "a").join(jump.select("a", "least"), "a")
    nexts = steps.groupBy("least").agg(F.map_from_entries(F.collect_list(F.struct("a", "b"))).alias("next"))
    way = F.aggregate(F.sequence(F.lit(1), F.size("next")), F.array("least"), lambda path, _: F.concat(path, F.array(F.element_at(F.col("next"), F.element_at(path, -1)))))
    return nexts.select(F.concat_ws("->", way).alias("path"))


def reach(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """(start, node): from every (start) what its references lead to, itself included; one join for each step of the longest way."""
    rounds = Rounds(starts.sparkSession)
    front = rounds.save(starts.select("start", F.col("start").alias("node")).distinct())
    have = front
    while not empty(front):
        step = front.join(edges.select(F.col("a").alias("node"), F.col("b").alias("next")), "node").select("start", F.col("next").alias("node")).distinct()
        front = rounds.save(step.join(have, ["start", "node"], "left_anti"))
        have = have.unionByName(front)
    return have


def reaching(marked: DataFrame, edges: DataFrame) -> DataFrame:
    """(node): the marked nodes (node) and all that refer to them, directly or not."""
    rounds = Rounds(marked.sparkSession)
    front = rounds.save(marked.select("node").distinct())
    have = front
    while not empty(front):
        step = front.join(edges.select(F.col("b").alias("node"), "a"), "node").select(F.col("a").alias("node")).distinct()
        front = rounds.save(step.join(have, "node", "left_anti"))
        have = have.unionByName(front)
    return have


def cycle_paths(edges: DataFrame, max_length: int = 100) -> DataFrame:
    """(path) like ``a->b->a`` of every simple cycle, from its least node; an error if one has more than ``max_length`` nodes.

    Cycles can be more than edges by any factor; whether there are any, and which, ``some_cycles`` tells.
    """
    rounds = Rounds(edges.sparkSession)
    edges = rounds.save(edges.select("a", "b"))
    if empty(edges):
        return edges.select(F.col("a").cast("string").alias("path"))
    core = on_cycles(edges)
    core = rounds.save(core)
    if empty(core):
        return core.select(F.col("a").cast("string").alias("path"))
    walks = core.select(F.col("a").alias("start"), F.col("b").alias("end"), F.array("a").alias("path"))
    found = None
    for _ in range(max_length):
        walks = rounds.save(walks)
        closed = walks.where("end = start").select(F.concat_ws("->", F.concat("path", F.array("end"))).alias("path"))
        found = closed if found is None else found.unionByName(closed)
        walks = walks.where((F.col("end") > F.col("start")) & ~F.array_contains("path", F.col("end")))
        if walks.isEmpty():
            break
        walks = walks.join(core.select(F.col("a").alias("end"), F.col("b").alias("next")), "end").select("start", F.col("next").alias("end"), F.concat("path", F.array("end")).alias("path"))
    else:
        raise CycleError(f"cycles of more than {max_length} nodes")
    return found


def closure(edges: DataFrame) -> DataFrame:
    """(a, b) for everything reachable, by doubling: as many rounds as the logarithm of the longest path."""
    rounds = Rounds(edges.sparkSession)
    have = rounds.save(edges.select("a", "b").distinct())
    n = have.count()
    while True:
        more = have.join(have.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b"))
        have = rounds.save(have.unionByName(more).distinct())
        if (m := have.count()) == n:
            return have
        n = m


def top_nodes(nodes: DataFrame, args: DataFrame, node: str = "gate_id", arg: str = "arg_id") -> DataFrame:
    """Gates that are no other gate's argument within the same tree (column ``tree`` on both sides)."""
    return nodes.join(args.select("tree", F.col(arg).alias(node)), ["tree", node], "left_anti")
