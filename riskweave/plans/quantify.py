"""Quantification: cut sets, approximations, importance, samples. The model format names these analyses without defining
their computation; formulas are those of published reliability literature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import CycleError
from ..functions import deviates
from ..operators import graphs
from ..operators.graphs import Rounds


def rare_event(p: Column, cap: float = 1.0) -> Column:
    """Sum of cut-set probabilities."""
    return F.least(F.sum(p), F.lit(cap))


def mcub(p: Column) -> Column:
    """1 - prod(1 - p): the minimal-cut upper bound."""
    return 1 - F.exp(F.sum(F.ln(1 - p)))


def fussell_vesely(cuts: DataFrame, p: DataFrame) -> DataFrame:
    """(arg, cuts, fussell_vesely) from (gate, arg) and (gate, p): the share of the cut sets with an event."""
    total = p.agg(F.sum("p").alias("total"))
    sums = cuts.join(p, "gate").groupBy("arg").agg(F.count("*").alias("cuts"), F.sum("p").alias("with_arg"))
    return sums.join(F.broadcast(total)).select("arg", "cuts", (F.col("with_arg") / F.col("total")).alias("fussell_vesely"))  # one row


def birnbaum(p_true: Column, p_false: Column) -> Column:
    return p_true - p_false


def cut_sets(tops: DataFrame, args: DataFrame, limit_order: int = 20, cut_off: float = 0.0, probabilities: DataFrame | None = None, absorb: bool = True) -> DataFrame:
    """(root, cut): minimal cut sets of every top gate by top-down expansion.

    ``args``: gate, connective (and, or), arg, is_gate; ids are texts or, in less room, numbers. All open gates of a round expand in one join: AND replaces a
    gate by all its arguments, OR gives a set for each. Sets beyond ``limit_order`` events, or by ``probabilities``
    (arg, p) below ``cut_off``, are cut off as these settings mean. Gates that refer to themselves are an error.
    """
    rounds = Rounds(tops.sparkSession)
    ands = args.where("connective = 'and'").groupBy("gate").agg(F.collect_set(F.struct("is_gate", "arg")).alias("all"))
    ors = args.where("connective = 'or'").select("gate", F.array(F.struct("is_gate", "arg")).alias("all"))
    of = lambda flag: F.transform(F.filter("all", lambda x: x["is_gate"] == flag), lambda x: x["arg"])
    step = rounds.save(ands.unionByName(ors).select("gate", of(True).alias("gates"), of(False).alias("events")))
    empty = F.array().cast(f"array<{dict(args.dtypes)['arg']}>")
    state = tops.select(F.col("gate").alias("root"), F.array("gate").alias("open"), empty.alias("cut"))
    done, turn = None, 0
    while True:
        turn += 1
        if turn % 100 == 0:  # deep, or without an end
            _, open_edges = graphs.levels(args.where("is_gate").select(F.col("gate").alias("a"), F.col("arg").alias("b")))
            if not open_edges.isEmpty():
                raise CycleError("gates refer to themselves")
        state = rounds.save(state)
        ended = state.where(F.size("open") == 0).select("root", "cut")
        done = ended if done is None else done.unionByName(ended)
        state = state.where(F.size("open") > 0)
        if state.isEmpty():
            break
        # sets that go on are held once; those that are done, at the end
        state = state.distinct().withColumn("gate", F.get("open", F.lit(0))).join(step, "gate")
        state = state.select("root", F.array_distinct(F.concat(F.slice("open", F.lit(2), F.greatest(F.size("open") - 1, F.lit(0))), "gates")).alias("open"), F.array_sort(F.array_union("cut", "events")).alias("cut"))
        state = state.where(F.size("cut") <= limit_order)
        if probabilities is not None and cut_off > 0:
            keyed = state.withColumn("_id", F.xxhash64("root", "open", "cut"))
            p = keyed.select("_id", F.explode("cut").alias("arg")).distinct().join(probabilities, "arg").groupBy("_id").agg(F.product("p").alias("_p")).where(F.col("_p") < cut_off)
            state = keyed.join(p.select("_id"), "_id", "left_anti").drop("_id")
    return minimal(done, once=True) if absorb else done.distinct()


#: Sets of one root that are held against each other in one row, at most; roots with more of them go through joins.
TOGETHER = 64


def many(sets: DataFrame) -> DataFrame:
    """(root) of the roots with more than ``TOGETHER`` sets."""
    return sets.groupBy("root").count().where(F.col("count") > TOGETHER).select("root")


def absorbing(sets: Column) -> Column:
    """An array of structs with ``cut``, without those whose set contains another one."""
    inside = lambda y, x: (F.size(y["cut"]) < F.size(x["cut"])) & (F.size(F.array_except(y["cut"], x["cut"])) == 0)
    return F.filter(sets, lambda x: ~F.exists(sets, lambda y: inside(y, x)))


def minimal(cuts: DataFrame, once: bool = False) -> DataFrame:
    """Rows (root, cut, ...) without those whose set contains another one of their root, all columns kept; equal rows are one with ``once``."""
    rounds = Rounds(cuts.sparkSession)
    cuts = rounds.save(cuts)
    large = rounds.save(many(cuts))
    few = cuts if graphs.empty(large) else cuts.join(large, "root", "left_anti")
    inner = [c for c in cuts.columns if c != "root"]
    few = few.groupBy("root").agg((F.collect_set if once else F.collect_list)(F.struct(*inner)).alias("all"))
    few = few.select("root", F.explode(F.when(F.size("all") > 1, absorbing(F.col("all"))).otherwise(F.col("all"))).alias("x")).select("root", "x.*").select(*cuts.columns)
    rest = cuts.join(large, "root", "left_semi")
    return few if graphs.empty(large) else few.unionByName(_minimal_by_joins(rest.distinct() if once else rest))


def _minimal_by_joins(cuts: DataFrame) -> DataFrame:
    """``minimal`` for any number of sets, found through the smaller set's rarest event."""
    each = cuts.select("root", "cut", F.explode("cut").alias("e"))
    counts = each.groupBy("root", "e").agg(F.count("*").alias("n"))
    small = each.join(counts, ["root", "e"]).groupBy("root", F.col("cut").alias("small")).agg(F.min_by("e", F.struct("n", "e")).alias("e"))
    large = each.select("root", "e", F.col("cut").alias("large"))
    inside = (F.size("small") < F.size("large")) & (F.size(F.array_except("small", "large")) == 0)
    absorbed = large.join(small, ["root", "e"]).where(inside).select("root", F.col("large").alias("cut"))
    certain = cuts.where(F.size("cut") == 0).select("root").distinct()  # the empty set is in all others
    over = cuts.where(F.size("cut") > 0).join(certain, "root", "left_semi").select("root", "cut")
    return cuts.join(absorbed.unionByName(over).distinct(), ["root", "cut"], "left_anti")


def trials(events: DataFrame, n: int, seed: int, node: str) -> DataFrame:
    """Every event in every trial, with a keyed uniform ``u``; trials are exploded, not joined."""
    rows = events.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return rows.withColumn("u", deviates.keyed_uniform(seed, F.col("trial"), F.col(node)))


def bins(x: Column, lo: float, hi: float, n: int) -> Column:
    """Bin number from 1 to n."""
    return F.least(F.floor((x - lo) / ((hi - lo) / n)).cast("long") + 1, F.lit(n).cast("long"))


#: Upper bounds of the failure-on-demand ranges of integrity levels 4 to 1.
SIL = ((4, 1e-4), (3, 1e-3), (2, 1e-2), (1, 1e-1))


def integrity_level(p: Column) -> Column:
    """Safety integrity level of an average failure probability; 0 above the range of level 1."""
    out = None
    for level, bound in SIL:
        out = F.when(p < bound, level) if out is None else out.when(p < bound, level)
    return out.otherwise(0)


def over_time(mission_time: float, time_step: float) -> Column:
    """The times at which a mission is analysed, its end included."""
    n = int(mission_time / time_step)
    times = [i * time_step for i in range(n + 1)] + ([mission_time] if n * time_step < mission_time else [])
    return F.array(*map(F.lit, times))
