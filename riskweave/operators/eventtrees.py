"""Event trees: order and fork rules, the walk from an initiating event to sequences, what instructions collect."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import CycleError
from .graphs import Rounds


def functional_order(events: DataFrame) -> DataFrame:
    """Functional events (tree, name, ordinal) numbered from 1 by position."""
    return events.withColumn("ord", F.row_number().over(Window.partitionBy("tree").orderBy("ordinal")))


def order_violations(forks: DataFrame) -> DataFrame:
    """Forks (tree, fork_id, parent_fork, ord) whose functional event does not come after their parent's."""
    parent = forks.select("tree", F.col("fork_id").alias("parent_fork"), F.col("ord").alias("parent_ord"))
    return forks.join(parent, ["tree", "parent_fork"]).where("ord <= parent_ord")


def duplicate_states(paths: DataFrame) -> DataFrame:
    """(fork_id, state) that a fork has twice."""
    return paths.groupBy("fork_id", "state").agg(F.count("*").alias("n")).where("n > 1")


def mixed_collections(instructions: DataFrame) -> DataFrame:
    """Trees whose instructions (tree, kind) collect both expressions and formulas."""
    kinds = instructions.where(F.col("kind").isin("collect-expression", "collect-formula"))
    return kinds.groupBy("tree").agg(F.countDistinct("kind").alias("kinds")).where("kinds > 1").select("tree")


def walk(starts: DataFrame, branches: DataFrame) -> DataFrame:
    """Every way from an initiating event to a sequence: (ie, sequence, context, p).

    ``starts``: ie, tree, branch. ``branches``: tree, branch, event (null in the first), state, target (``fork``,
    ``branch`` or ``sequence``), next (branch, or sequence), p (collected there). All ways of one depth advance in one
    join; each carries its own context of functional events and states. Branches that lead back to themselves are an error.
    """
    rounds = Rounds(starts.sparkSession)
    none = F.create_map().cast("map<string,string>")
    open_ = starts.select("ie", "tree", "branch", none.alias("context"), F.lit(1.0).alias("p"))
    ended, depth, most = None, 0, None
    while True:
        here = open_.withColumnRenamed("p", "so_far").join(branches, ["tree", "branch"])
        known = F.when(F.col("event").isNull(), F.col("context")).otherwise(F.map_concat(F.map_filter("context", lambda k, _: k != F.col("event")), F.create_map("event", "state")))
        here = rounds.save(here.select("ie", "tree", known.alias("context"), (F.col("so_far") * F.coalesce("p", F.lit(1.0))).alias("p"), "target", "next"))
        done = here.where("target = 'sequence'").select("ie", F.col("next").alias("sequence"), "context", "p")
        ended = done if ended is None else ended.unionByName(done)
        open_ = here.where("target <> 'sequence'").select("ie", "tree", F.col("next").alias("branch"), "context", "p")
        if open_.isEmpty():
            return ended
        depth += 1
        if depth >= 100 and depth > (most := most or branches.select("tree", "branch").distinct().count()):
            raise CycleError("branches lead back to themselves")


def collected_product(instructions: DataFrame, *key: str) -> DataFrame:
    """The product of collected expressions (key, value)."""
    return instructions.groupBy(*key).agg(F.product("value").alias("p"))


def last_house_states(instructions: DataFrame) -> DataFrame:
    """The state that the last set-house-event of each (owner, name) leaves, by ordinal."""
    return instructions.groupBy("owner", "name").agg(F.max_by("state", "ordinal").alias("state"))
