"""Connected components of a table of links, by hooking and pointer jumping in Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root) for every node of (a, b): the least node of its component. Nodes are of any orderable type.

    Every node hooks to its least neighbour, chains of hooks are halved by joins until they end, links are renamed by
    their roots; rounds go on until no link is left. Nothing but counts comes to the driver.
    """
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = scratch.save(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-edges-0")
    roots = None
    step = 0
    while not edges.isEmpty():
        step += 1
        hooks = both(edges).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
        hooks = scratch.save(hooks.select("node", F.least("node", "m").alias("root")), f"{name}-hooks-{step}-0")
        for jump in range(1, 64):
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("upper"))
            after = scratch.save(hooks.join(up, "root").select("node", F.col("upper").alias("root"), (F.col("upper") != F.col("root")).alias("moved")), f"{name}-hooks-{step}-{jump}")
            moved = not after.where("moved").isEmpty()
            scratch.drop(f"{name}-hooks-{step}-{jump - 1}")
            hooks = after.select("node", "root")
            if not moved:
                break
        to = lambda c: hooks.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
        renamed = edges.join(to("a"), "a").join(to("b"), "b").where("ra <> rb")
        renamed = scratch.save(renamed.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), f"{name}-edges-{step}")
        if roots is None:
            roots = hooks
        else:
            moved_on = hooks.select(F.col("node").alias("root"), F.col("root").alias("upper"))
            roots = roots.join(moved_on, "root", "left").select("node", F.coalesce("upper", "root").alias("root"))
        roots = scratch.save(roots, f"{name}-roots-{step}")
        edges = renamed
    return roots if roots is not None else links.select(F.col("a").alias("node"), F.col("a").alias("root")).where("false")
