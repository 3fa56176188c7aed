"""Sequences of event trees: all ways from initiating events, with what instructions do along each of them.

Ways go through forks first, all of one depth in one join, and note the units that they pass with the context of functional
events there. Then the instructions of these units are carried out: conditions and collected expressions that test
events are evaluated once for each unit and context, everything else once for a unit. At last the effects of a
way are folded in their order; a sequence with a link goes on in the linked tree with all that it has collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import CycleError
from ..operators import elements, graphs
from . import evaluate, exact
from .trees import _unit, formula_id

_HOUSES = "map<string,boolean>"
_FORMULA = f"struct<gate:string,houses:{_HOUSES}>"


def _instructions(model, rounds: graphs.Rounds, found: evaluate.Contextual) -> dict[str, DataFrame]:
    """children: instructions with their place; conditions: of each ``if`` its condition and arms; below: the expression
    that an instruction collects; contextual: the units whose instructions, rules included, test events."""
    nodes = model.tree_nodes.select("file", "node", "parent", "ordinal", "tag").where("tag <> 'label' AND tag <> 'attributes'")
    steps = model.instructions.select("file", "node", "parent", "owner", "kind", "ref", "state")
    children = rounds.save(steps.join(nodes.select("file", "node", "ordinal"), ["file", "node"]))
    inside = nodes.join(steps.where("kind = 'if'").select("file", F.col("node").alias("parent")), ["file", "parent"])
    conditions = inside.groupBy("file", F.col("parent").alias("node")).agg(F.concat_ws("#", F.first("file"), F.min_by("node", "ordinal")).alias("key"), F.sort_array(F.collect_list("ordinal")).alias("places"))
    conditions = rounds.save(conditions)
    keyed = nodes.select("file", F.col("parent").alias("node"), F.concat_ws("#", "file", "node").alias("key"))
    below = rounds.save(keyed.join(steps.where("kind = 'collect-expression'").select("file", "node"), ["file", "node"]))
    testing = conditions.select("file", "node", "key").unionByName(below).join(found.dependent.withColumnRenamed("node", "key"), "key", "left_semi")
    marked = testing.join(steps.select("file", "node", "owner"), ["file", "node"]).select(_unit("owner").alias("node")).distinct()
    rules = model.rules.select(F.col("name").alias("ref"), _unit().alias("b"))
    calls = steps.where("kind = 'rule'").join(rules, "ref").select(_unit("owner").alias("a"), "b").distinct()
    contextual = marked if found.none else graphs.reaching(marked, calls)
    return {"children": children, "conditions": conditions, "below": below, "contextual": rounds.save(contextual.withColumnRenamed("node", "unit"))}


def effects(model, visits: DataFrame, contexts: DataFrame, tables: dict[str, DataFrame], found: evaluate.Contextual, rounds: graphs.Rounds) -> DataFrame:
    """(unit, ctx, effects): what the instructions of each unit do in each context of ``visits`` (unit, ctx), in order."""
    children = tables["children"]
    rules = model.rules.select(F.col("name").alias("ref"), F.col("file").alias("rule_file"), F.col("node").alias("rule"))
    at = F.struct("file", "ordinal", "node")
    columns = ("unit", "ctx", "file", "node", "kind", "ref", "state")
    top = children.where("parent = owner").withColumn("unit", _unit("owner")).join(visits, "unit").select(*columns, F.array(at).alias("at"))
    front = rounds.save(top)
    all_, depth, most = front, 0, None
    while not graphs.empty(front):
        inner = lambda rows, *by: rows.join(children, list(by)).select("unit", "ctx", "file", "node", "kind", "ref", "state", F.concat("above", F.array(at)).alias("at"))
        blocks = front.where("kind = 'block'").select("unit", "ctx", "file", F.col("node").alias("parent"), F.col("at").alias("above"))
        more = [inner(blocks, "file", "parent")]
        called = front.where("kind = 'rule'").join(rules, "ref").select("unit", "ctx", F.col("rule_file").alias("file"), F.col("rule").alias("parent"), F.col("at").alias("above"))
        more.append(inner(called, "file", "parent"))
        ifs = rounds.save(front.where("kind = 'if'").join(tables["conditions"], ["file", "node"]).select("unit", "ctx", "file", F.col("node").alias("parent"), F.col("at").alias("above"), "key", "places"))
        if not graphs.empty(ifs):
            known = found.evaluate(ifs.select("ctx", "key").distinct(), contexts)
            arm = F.get("places", F.when(F.col("value") != 0, 1).otherwise(2))
            more.append(inner(ifs.join(known, ["ctx", "key"]).withColumn("ordinal", arm).drop("key", "places", "value"), "file", "parent", "ordinal"))
        front = rounds.save(elements.union(more))
        all_ = all_.unionByName(front)
        depth += 1
        if depth >= 100 and depth > (most := most or children.count()):
            raise CycleError("rules refer to themselves")
    acts = rounds.save(all_.where("kind NOT IN ('block', 'rule', 'if')"))
    collected = acts.where("kind = 'collect-expression'").join(tables["below"], ["file", "node"]).select("unit", "ctx", "at", "key")
    values = collected.join(found.evaluate(collected.select("ctx", "key").distinct(), contexts), ["ctx", "key"]).select("unit", "ctx", "at", "value")
    acts = acts.join(values, ["unit", "ctx", "at"], "left")
    ref = F.when(F.col("kind") == "collect-formula", formula_id()).otherwise(F.col("ref"))
    return acts.groupBy("unit", "ctx").agg(F.sort_array(F.collect_list(F.struct("at", "kind", ref.alias("ref"), "state", "value"))).alias("effects"))


def _folded(acts: Column, houses: Column, formulas: Column) -> Column:
    """(houses, formulas) after the effects; a formula is collected with the house states that are set by then."""

    def step(so_far: Column, act: Column) -> Column:
        sets, formula = act["kind"] == "set-house-event", act["kind"] == "collect-formula"
        states = F.when(sets, F.map_concat(F.map_filter(so_far["houses"], lambda k, _: k != act["ref"]), F.create_map(F.coalesce(act["ref"], F.lit("")), act["state"]))).otherwise(so_far["houses"])
        one = F.struct(act["ref"].alias("gate"), so_far["houses"].alias("houses"))
        return F.struct(states.alias("houses"), F.when(formula, F.concat(so_far["formulas"], F.array(one))).otherwise(so_far["formulas"]).alias("formulas"))

    return F.aggregate(acts, F.struct(houses.alias("houses"), formulas.alias("formulas")), step)


def ways(model) -> DataFrame:
    """(ie, sequence, context, p, houses, formulas) of all ways: p of the collected expressions, formulas with their house states."""
    rounds = graphs.Rounds(model.nodes.sparkSession)
    found = evaluate.Contextual(model, rounds)
    tables = _instructions(model, rounds, found)
    contextual = tables["contextual"].withColumn("tests", F.lit(True))
    named = model.branches.where("kind = 'define-branch'").select("tree", F.col("name").alias("next"), F.col("unit").alias("to"))
    follow = F.when(F.col("target") == "branch", F.col("to")).otherwise(F.col("next"))
    branches = model.branches.join(named, ["tree", "next"], "left").join(contextual, "unit", "left").select(F.coalesce("fork", "unit").alias("branch"), "unit", "event", F.col("state").alias("to_state"), "target", follow.alias("next"), "tests")
    branches = rounds.save(branches)
    sequences = rounds.save(model.sequences.select(_unit().alias("unit"), F.col("name").alias("next")).join(contextual, "unit", "left"))
    starts = rounds.save(model.branches.where("kind = 'initial-state'").select("tree", F.col("unit").alias("branch")))
    empty = F.create_map().cast("map<string,string>")
    # what tests see of a context: the same text for the same initiating event and states
    seen = F.concat_ws("\u0001", "ie", F.array_join(F.transform(F.array_sort(F.map_entries("context")), lambda e: F.concat(e["key"], F.lit("\u0002"), e["value"])), "\u0003"))
    visit = F.struct("unit", F.when(F.col("tests"), seen).otherwise("").alias("ctx"), F.when(F.col("tests"), F.col("context")).alias("fe"))
    open_ = model.initiating_events.join(starts, "tree").select(F.col("name").alias("ie"), empty.alias("context"), F.lit(1.0).alias("p"), F.create_map().cast(_HOUSES).alias("houses"), F.array().cast(f"array<{_FORMULA}>").alias("formulas"), "branch")
    ended, hops, trees = None, 0, starts.select("tree").distinct().count()
    carried = ("ie", "p", "houses", "formulas")
    while True:
        front = open_.withColumn("trail", F.array().cast("array<struct<unit:string,ctx:string,fe:map<string,string>>>"))
        arrived, depth, most = None, 0, None
        while True:
            here = front.join(branches, "branch")
            context = F.when(F.col("event").isNull(), F.col("context")).otherwise(F.map_concat(F.map_filter("context", lambda k, _: k != F.col("event")), F.create_map(F.coalesce("event", F.lit("")), "to_state")))
            here = here.withColumn("context", context).withColumn("trail", F.concat("trail", F.array(visit)))
            here = rounds.save(here.select(*carried, "context", "trail", "target", "next"))
            done = here.where("target = 'sequence'").select(*carried, "context", "trail", "next")
            arrived = done if arrived is None else arrived.unionByName(done)
            front = here.where("target <> 'sequence'").select(*carried, "context", "trail", F.col("next").alias("branch"))
            if graphs.empty(front):
                break
            depth += 1
            if depth >= 100 and depth > (most := most or branches.count()):
                raise CycleError("branches lead back to themselves")
        arrived = arrived.join(sequences, "next").withColumn("trail", F.concat("trail", F.array(visit))).select(F.monotonically_increasing_id().alias("way"), *carried, "context", "trail", F.col("next").alias("sequence"))
        arrived = rounds.save(arrived)
        passed = rounds.save(arrived.select("way", "ie", F.posexplode("trail").alias("place", "at")).select("way", "ie", "place", "at.*"))
        contexts = rounds.save(passed.where("fe IS NOT NULL").groupBy("ctx").agg(F.first(F.struct("ie", "fe")).alias("c")).select("ctx", "c.ie", "c.fe"))
        acts = rounds.save(effects(model, passed.select("unit", "ctx").distinct(), contexts, tables, found, rounds))
        done = passed.join(acts, ["unit", "ctx"]).groupBy("way").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("place", "effects"))), lambda x: x["effects"])).alias("acts"))
        none = F.array().cast(dict(done.dtypes)["acts"])
        rows = arrived.drop("trail").join(done, "way", "left").withColumn("acts", F.coalesce("acts", none))
        rows = rows.withColumn("after", _folded(F.col("acts"), F.col("houses"), F.col("formulas")))
        product = F.aggregate(F.filter("acts", lambda x: x["kind"] == "collect-expression"), F.col("p"), lambda a, x: a * x["value"])
        links = F.transform(F.filter("acts", lambda x: x["kind"] == "event-tree"), lambda x: x["ref"])
        rows = rounds.save(rows.select("ie", "sequence", "context", product.alias("p"), "after.houses", "after.formulas", links.alias("links")))
        over = rows.where(F.size("links") == 0).drop("links")
        ended = over if ended is None else ended.unionByName(over)
        on = rows.where(F.size("links") > 0)
        if on.isEmpty():
            return ended
        hops += 1
        if hops > trees:
            raise CycleError("links lead back to their tree")
        open_ = on.withColumn("tree", F.explode("links")).join(starts, "tree").select("ie", "context", "p", "houses", "formulas", "branch")


def walk(model) -> DataFrame:
    """(ie, sequence, context, p) of all ways: the collected expressions times the exact probability that all collected formulas hold.

    Each formula is taken with the house events as the way has set them when it is collected. A sequence with several links
    goes on in each of the linked trees.
    """
    found = ways(model)
    rounds = graphs.Rounds(model.nodes.sparkSession)
    rows = rounds.save(found.withColumn("way", F.monotonically_increasing_id()))
    plain = rows.where(F.size("formulas") == 0).select("ie", "sequence", "context", "p")
    rows = rows.where(F.size("formulas") > 0)
    if rows.isEmpty():
        return plain
    states = lambda houses: F.array_join(F.transform(F.array_sort(F.map_entries(houses)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    collected = rounds.save(rows.select("way", F.explode("formulas").alias("f")).select("way", F.col("f.gate").alias("id"), "f.houses").withColumn("scenario", states("houses")))
    set_ = collected.select("scenario", F.explode("houses").alias("house_event", "state")).distinct()
    g, placed = exact.in_states(exact.graph(model), model.house_events, collected.select("id", "scenario").distinct(), set_)
    gates = collected.join(placed, ["id", "scenario"]).groupBy("way").agg(F.sort_array(F.collect_set("gate")).alias("all"))
    gates = rounds.save(gates.withColumn("top", F.concat(F.lit("all:"), F.array_join("all", "\u0002"))))
    tops = rounds.save(gates.select("top", "all").distinct())
    number = F.lit(None).cast("int")
    top_gates = tops.select(F.col("top").alias("id"), F.when(F.size("all") == 1, "null").otherwise("and").alias("connective"), number.alias("min_num"), number.alias("max_num"))
    top_args = tops.select(F.col("top").alias("gate_id"), F.posexplode("all").alias("ordinal", "arg_id")).withColumn("complement", F.lit(False))
    whole = exact.Graph(g.gates.unionByName(top_gates), g.args.unionByName(top_args), g.events)
    p = exact.probabilities(whole, tops.select(F.col("top").alias("id"))).select(F.col("id").alias("top"), F.col("p").alias("holds"))
    with_formulas = rows.join(gates.select("way", "top"), "way").join(p, "top").select("ie", "sequence", "context", (F.col("p") * F.col("holds")).alias("p"))
    return rounds.save(plain.unionByName(with_formulas))
