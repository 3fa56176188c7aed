"""Smaller graphs with the same truth: constants carried up, gates of one argument taken out, equal gates made one.

Gates are gone through from the lowest level. What a gate has become, a literal, a constant or another gate, stands in the
place of its references above; gates with the same connective, numbers and arguments are one by a text that names them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import CycleError
from ..operators import graphs
from .exact import FALSE, TRUE, Graph


def _shapes(rows: DataFrame) -> DataFrame:
    """From gates with ``args`` (arg, c, ordinal), c the complement: ``kind`` and, or, atleast, cardinality, xor or a literal, ``flip``, and what is left of args."""
    kind, n = F.col("connective"), F.size("args")
    # implications and negations are other gates with complements
    args = F.when(kind == "imply", F.transform("args", lambda x: F.struct(x["arg"].alias("arg"), (x["c"] != (x["ordinal"] == 0)).alias("c"), x["ordinal"].alias("ordinal")))).otherwise(F.col("args"))
    rows = rows.withColumns({"args": args, "flip": kind.isin("nand", "nor", "iff", "not"), "kind": F.when(kind.isin("nand", "null", "not"), "and").when(kind.isin("nor", "imply"), "or").when(kind == "iff", "xor").otherwise(kind)})
    constant = lambda x: x["arg"].isin(TRUE, FALSE)
    rows = rows.withColumn("trues", F.size(F.filter("args", lambda x: constant(x) & ((x["arg"] == TRUE) != x["c"])))).withColumn("falses", F.size(F.filter("args", constant)) - F.col("trues"))
    rows = rows.withColumn("args", F.array_sort(F.transform(F.filter("args", lambda x: ~constant(x)), lambda x: F.struct(x["arg"].alias("arg"), x["c"].alias("c")))))
    kind, trues = F.col("kind"), F.col("trues")
    # every kind as bounds on the number of true arguments that are left
    low = F.when(kind == "and", n).when(kind == "or", 1 - F.least(trues, F.lit(1))).when(kind == "xor", 1 - trues).otherwise(F.col("min_num") - trues)
    high = F.when(kind == "and", n).when(kind.isin("or", "atleast"), n).when(kind == "xor", 1 - trues).otherwise(F.col("max_num") - trues)
    rows = rows.withColumns({"low": F.when((kind == "and") & (F.col("falses") > 0), F.lit(1 << 30)).otherwise(F.greatest(low, F.lit(0))), "high": F.least(high, n)})
    # duplicates and opposites count once, or decide, where all or any are asked for
    once = F.array_distinct("args")
    opposed = F.exists(once, lambda x: F.exists(once, lambda y: (y["arg"] == x["arg"]) & (y["c"] != x["c"])))
    every, any_ = (F.col("low") == n) & (F.col("high") == n) & (n > 0), (F.col("low") == 1) & (F.col("high") == n)
    decided = F.when((F.col("low") > F.col("high")) | (F.col("high") < 0), False).when((F.col("low") <= 0) & (F.col("high") >= n), True).when(every & opposed, False).when(any_ & opposed, True)
    rows = rows.withColumns({"decided": decided, "every": every, "any": any_, "once": once})
    rows = rows.withColumn("args", F.when(F.col("every") | F.col("any"), F.col("once")).otherwise(F.col("args")))
    none = (F.col("high") == 0) & (F.size("args") > 0)  # none may be true
    rows = rows.withColumns({"flip": F.col("flip") != (none & ~F.col("every")), "any": F.col("any") | none})
    single = (F.size("args") == 1) & (F.col("every") | F.col("any"))
    state = F.when(F.col("decided").isNotNull(), F.when(F.col("decided") != F.col("flip"), TRUE).otherwise(FALSE))
    literal = F.when(single & state.isNull(), F.get("args", F.lit(0)))
    return rows.withColumns({
        "to": F.coalesce(state, literal["arg"]), "to_c": F.coalesce(literal["c"] != F.col("flip"), F.lit(False)),
        "kind": F.when(F.col("every"), "and").when(F.col("any"), "or").when(F.col("high") == F.size("args"), "atleast").otherwise("cardinality"),
    })


def _key(kind: Column, low: Column, high: Column, args: Column) -> Column:
    number = lambda x: F.when(kind.isin("and", "or"), "").otherwise(x.cast("string"))
    return F.concat_ws("\u0002", kind, number(low), F.when(kind == "cardinality", high.cast("string")).otherwise(""), F.array_join(F.transform(args, lambda x: F.concat(F.when(x["c"], "!").otherwise(""), x["arg"])), "\u0001"))


def simplified(g: Graph, roots: DataFrame) -> tuple[Graph, DataFrame]:
    """(graph, roots): the gates below ``roots`` (id) made fewer, and where each root went: id, to, to_c (whether complemented)."""
    rounds = graphs.Rounds(g.gates.sparkSession)
    edges = rounds.save(g.edges)
    placed, left = graphs.levels(edges)
    if not graphs.empty(left):
        raise CycleError("gates refer to themselves")
    gates = rounds.save(g.gates.join(placed.select(F.col("node").alias("id"), "level"), "id", "left").fillna(0, ["level"]))
    args = rounds.save(g.args)
    top = gates.agg(F.max("level")).first()[0]
    moved = kept = None  # id -> to, to_c; gates that stay, by their keys
    for level in range((top if top is not None else -1) + 1):
        here = gates.where(F.col("level") == level).withColumnRenamed("id", "gate_id")
        each = args.join(here.select("gate_id"), "gate_id", "left_semi")
        if moved is not None:
            each = each.join(moved.withColumnRenamed("id", "arg_id"), "arg_id", "left").select("gate_id", "ordinal", F.coalesce("to", "arg_id").alias("arg_id"), (F.col("complement") != F.coalesce("to_c", F.lit(False))).alias("complement"))
        lists = each.groupBy("gate_id").agg(F.collect_list(F.struct(F.col("arg_id").alias("arg"), F.col("complement").alias("c"), "ordinal")).alias("args"))
        shaped = _shapes(here.join(lists, "gate_id"))
        shaped = rounds.save(shaped.select("gate_id", "to", "to_c", "flip", "kind", "low", "high", "args", _key(F.col("kind"), F.col("low"), F.col("high"), F.col("args")).alias("key")))
        gone = shaped.where("to IS NOT NULL").select(F.col("gate_id").alias("id"), "to", "to_c")
        stays = shaped.where("to IS NULL")
        first = stays.groupBy("key").agg(F.min_by(F.struct("gate_id", "kind", "low", "high", "args"), "gate_id").alias("g")).select("key", "g.*")
        if kept is not None:  # a lower level may have the same gate
            first = first.join(kept.select("key"), "key", "left_anti")
        first = rounds.save(first)
        kept = first if kept is None else kept.unionByName(first)
        same = stays.select("gate_id", "flip", "key").join(kept.select("key", F.col("gate_id").alias("to")), "key").select(F.col("gate_id").alias("id"), "to", F.col("flip").alias("to_c"))
        new = rounds.save(gone.unionByName(same))
        moved = new if moved is None else moved.unionByName(new)
    if moved is None:
        return g, roots.select("id", F.col("id").alias("to"), F.lit(False).alias("to_c"))
    ends = rounds.save(roots.select("id").distinct().join(moved, "id", "left").select("id", F.coalesce("to", "id").alias("to"), F.coalesce("to_c", F.lit(False)).alias("to_c")))
    links = kept.select(F.col("gate_id").alias("a"), F.explode(F.transform("args", lambda x: x["arg"])).alias("b"))
    needed = graphs.reach(ends.select(F.col("to").alias("start")).distinct(), links).select(F.col("node").alias("gate_id")).distinct()
    kept = rounds.save(kept.join(needed, "gate_id", "left_semi"))
    out = kept.select(F.col("gate_id").alias("id"), F.col("kind").alias("connective"), F.when(F.col("kind").isin("atleast", "cardinality"), F.col("low")).cast("int").alias("min_num"), F.when(F.col("kind") == "cardinality", F.col("high")).cast("int").alias("max_num"))
    out_args = kept.select("gate_id", F.posexplode("args").alias("ordinal", "x")).select("gate_id", "ordinal", F.col("x.arg").alias("arg_id"), F.col("x.c").alias("complement"))
    return Graph(out, out_args, g.events), ends


def probabilities(g: Graph, roots: DataFrame) -> DataFrame:
    """(id, p) of ``roots`` (id), exact, over the simplified graph."""
    from . import exact

    small, ends = simplified(g, roots)
    gates = ends.join(small.gates.select(F.col("id").alias("to")), "to", "left_semi").select(F.col("to").alias("id")).distinct()
    fixed = g.gates.sparkSession.createDataFrame([(TRUE, 1.0), (FALSE, 0.0)], "id string, p double")
    p = exact.probabilities(small, gates).unionByName(g.events.select("id", "p")).unionByName(fixed).withColumnRenamed("id", "to")
    return ends.join(p, "to", "left").select("id", F.when(F.col("to_c"), 1 - F.col("p")).otherwise(F.col("p")).alias("p"))
