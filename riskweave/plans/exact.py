"""Exact probabilities of gates whose arguments share events, and importance of events, by decision diagrams.

A diagram belongs to a root and is built from the top, one variable a round, all roots at once: a node is what is left of
the gates when the variables so far are known. Nodes that leave the same undecided gates with the same numbers of
true arguments are one node, found by grouping; so a layer is never larger than the distinct rests. The probability of the
root is the weight that reaches truth. Gates under which nothing is shared need no diagram: the formula for independent
arguments is exact for them, and they are single variables of the diagrams above.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import CycleError
from ..operators import formulas, graphs
from . import evaluate
from .model import Model

TRUE, FALSE = "__true__", "__false__"
#: Between the parts of a node's name: no name has it.
MARK = "\u0001"


@dataclass
class Graph:
    """``gates`` id, connective, min_num, max_num; ``args`` gate_id, ordinal, arg_id, complement; ``events`` id, p. Constants are TRUE and FALSE.

    ``flat``: whether no gate is an argument, as far as that is known; ``links``: the ``edges``, if they are known.
    """

    gates: DataFrame
    args: DataFrame
    events: DataFrame
    flat: bool = False
    links: DataFrame | None = None

    @property
    def edges(self) -> DataFrame:
        """(a, b): gates and the gates among their arguments."""
        if self.flat:
            return self.args.select(F.col("gate_id").alias("a"), F.col("arg_id").alias("b")).where("false")
        if self.links is not None:
            return self.links
        return self.args.select(F.col("gate_id").alias("a"), F.col("arg_id").alias("b")).join(self.gates.select(F.col("id").alias("b")), "b", "left_semi").select("a", "b").distinct()

    def below(self, gates: DataFrame, rounds: graphs.Rounds) -> Graph:
        """The part of the graph with the gates (gate_id) only."""
        found = rounds.save_all({"gates": graphs.only(self.gates, gates.select(F.col("gate_id").alias("id")), "id"), "args": graphs.only(self.args, gates, "gate_id")})
        return Graph(found["gates"], found["args"], self.events, self.flat)

    def saved(self, rounds: graphs.Rounds) -> Graph:
        """The same graph in tables that are written; those that are already stay as they are."""
        keep = lambda t: t if "_saved_rows" in t.__dict__ else rounds.save(t)
        return Graph(keep(self.gates), keep(self.args), keep(self.events), self.flat, self.links)


def graph(model: Model, events: DataFrame | None = None, roots: DataFrame | None = None, combined: DataFrame | None = None) -> Graph:
    """The gates of a model, common causes applied, over ``events`` (id, p) or the model's own; house events stay names, see ``in_states``.

    With ``roots`` (id) only of common-cause groups with a member below some gate or among them; their events are ``combined``, if known.
    """
    if roots is not None and combined is None:
        combined = evaluate.needed_events(model, roots)
    base = (events if events is not None else evaluate._base(model, combined)).select("id", "p")
    if combined is not None and graphs.empty(combined):
        # the tables as they are, written already
        args = graphs.same_rows(model.gate_args.select("gate_id", "ordinal", "arg_id", "complement"), model.gate_args)
        return Graph(model.gates, args, base, graphs.empty(model.gate_edges))
    gates, args, _ = evaluate._applied(model, combined)
    return Graph(gates, args, base)


def _constants(state: Column) -> Column:
    return F.when(state, TRUE).otherwise(FALSE)


def in_states(g: Graph, houses: DataFrame, roots: DataFrame, states: DataFrame | None = None) -> tuple[Graph, DataFrame]:
    """The gates under ``roots`` once for each set of states: (graph, roots with the id of their gate there).

    ``roots``: id, scenario. ``houses``: id, state as declared. ``states``: scenario, house_event, state, which override
    it. Gates without a changed house event below stay one for all scenarios; roots get a column ``gate``.
    """
    rounds = graphs.Rounds(g.gates.sparkSession)
    declared = houses.select(F.col("id").alias("arg_id"), F.col("state").alias("declared"))
    if states is None or states.isEmpty():
        if houses.isEmpty():
            return g.saved(rounds), roots.withColumn("gate", F.col("id"))
        args = g.args.join(declared, "arg_id", "left").withColumn("arg_id", F.when(F.col("declared").isNull(), F.col("arg_id")).otherwise(_constants(F.col("declared")))).drop("declared")
        return Graph(g.gates, args, g.events, g.flat, g.links).saved(rounds), roots.withColumn("gate", F.col("id"))
    states = rounds.save(states.select("scenario", F.col("house_event").alias("arg_id"), "state").distinct())
    direct = g.args.join(states, "arg_id").select("scenario", F.col("gate_id").alias("node")).distinct()
    own = F.concat("scenario", F.lit(MARK), "node")
    edges, front = g.edges, rounds.save(direct)
    touched = front
    while not graphs.empty(front):  # what refers to them, scenario by scenario
        up = front.join(edges.withColumnRenamed("b", "node"), "node").select("scenario", F.col("a").alias("node")).distinct()
        front = rounds.save(up.join(touched, ["scenario", "node"], "left_anti"))
        touched = touched.unionByName(front)
    touched = rounds.save(touched)
    copies = touched.join(g.gates.withColumnRenamed("id", "node"), "node").withColumn("id", own).select(*g.gates.columns)
    inside = g.args.join(touched.select("scenario", F.col("node").alias("gate_id")), "gate_id")
    inside = inside.join(states, ["scenario", "arg_id"], "left").join(declared, "arg_id", "left").join(touched.select("scenario", F.col("node").alias("arg_id"), F.lit(True).alias("copied")), ["scenario", "arg_id"], "left")
    state = F.coalesce("state", "declared")
    inside = inside.select(
        F.concat("scenario", F.lit(MARK), "gate_id").alias("gate_id"), "ordinal",
        F.when(state.isNotNull(), _constants(state)).when(F.col("copied"), F.concat("scenario", F.lit(MARK), "arg_id")).otherwise(F.col("arg_id")).alias("arg_id"), "complement",
    )
    plain = g.args.join(declared, "arg_id", "left").withColumn("arg_id", F.when(F.col("declared").isNull(), F.col("arg_id")).otherwise(_constants(F.col("declared")))).select("gate_id", "ordinal", "arg_id", "complement")
    placed = roots.join(touched.select("scenario", F.col("node").alias("id"), F.lit(True).alias("copied")), ["scenario", "id"], "left")
    placed = placed.withColumn("gate", F.when(F.col("copied"), F.concat("scenario", F.lit(MARK), "id")).otherwise(F.col("id"))).drop("copied")
    return Graph(g.gates.unionByName(copies), plain.unionByName(inside), g.events).saved(rounds), placed


#: Nodes below a gate that are held in its row, at most; gates with more of them are taken for ones that may share some.
MOST_BELOW = 64


#: What an id is: a constant, an event or a gate.
FIXED, EVENT, GATE = 0, 1, 2


def independent(g: Graph, placed: DataFrame | None = None, points: int = 0, slopes: bool = False) -> DataFrame:
    """(id, p, twice, kind) of events and gates, arguments taken as independent, and whether something below may be referred to more than once.

    ``placed``: the gates' levels (node, level), if they are known. Without anything twice below, p is exact. With ``points``
    every p is an array of so many, those of the graph's events as well. With ``slopes`` there is a column of that name: the
    derivatives of gates by their arguments (id, slope, kind, p).
    """
    rounds = graphs.Rounds(g.gates.sparkSession)
    none = F.array().cast("array<bigint>")
    certain = F.col("id") == 1
    sure = F.when(certain, 1.0).otherwise(0.0)
    fixed = g.gates.sparkSession.range(2).select(_constants(certain).alias("id"), (F.array_repeat(sure, points) if points else sure).alias("p"))
    known = g.events.select("id", "p").unionByName(fixed)
    kind = F.when(F.col("id").isin(TRUE, FALSE), FIXED).otherwise(EVENT)
    flat_down = [F.lit(None).cast("array<struct<id:string,slope:double,kind:int,p:double>>").alias("slopes")] if slopes else []
    done = rounds.save(known.select("id", "p", none.alias("below"), F.lit(False).alias("twice"), kind.alias("kind"), *flat_down))
    placed = graphs.levels(g.edges)[0] if placed is None else placed
    top = 0 if g.flat else placed.agg(F.max("level")).first()[0] or 0
    parts = g.args
    if top:  # the arguments of each level are dealt out once, and each level reads its own only
        gates = g.gates.join(placed.select(F.col("node").alias("id"), "level"), "id", "left").fillna(0, ["level"])
        parts = rounds.save(g.args.join(gates.withColumnRenamed("id", "gate_id"), "gate_id"), "level")

    def one(ps: Column) -> Column:
        return F.when(~F.exists(ps, lambda x: x.isNull()), formulas.probability(F.col("connective"), ps, F.col("min_num"), F.col("max_num")))

    def down(ps: Column) -> Column:
        """The slopes of a row's gate by its arguments."""
        at = lambda i, v: F.transform(ps, lambda q, j: F.when(j == i, F.lit(v)).otherwise(q))
        value = lambda ps: formulas.probability(F.col("connective"), ps, F.col("min_num"), F.col("max_num"))
        sign = lambda x: F.when(x["complement"], -1.0).otherwise(1.0)
        return F.transform("args", lambda x, i: F.struct(x["arg_id"].alias("id"), (sign(x) * (value(at(i, 1.0)) - value(at(i, 0.0)))).alias("slope"), x["kind"].alias("kind"), F.when(x["complement"], 1 - x["p"]).otherwise(x["p"]).alias("p")))

    for level in range(top + 1):
        args = (parts.where(F.col("level") == level) if top else parts).join(done.drop("slopes").withColumnRenamed("id", "arg_id"), "arg_id", "left")
        turned = F.transform("p", lambda x: 1 - x) if points else 1 - F.col("p")
        p = F.when(F.col("complement"), turned).otherwise(F.col("p"))
        own = F.when(F.col("arg_id").isin(TRUE, FALSE), none).otherwise(F.array(F.xxhash64("arg_id")))
        arg = F.struct("ordinal", p.alias("p"), F.concat(own, F.coalesce("below", none)).alias("below"), F.coalesce("twice", F.lit(False)).alias("twice"), *(["arg_id", "complement", "kind"] if slopes else []))
        gathered = F.sort_array(F.collect_list(arg)).alias("args")
        got = args.groupBy("gate_id", "connective", "min_num", "max_num").agg(gathered) if top else args.groupBy("gate_id").agg(gathered).join(g.gates.withColumnRenamed("id", "gate_id"), "gate_id")
        got = got.select("gate_id", "connective", "min_num", "max_num", *(["args"] if slopes else []), F.transform("args", lambda x: x["p"]).alias("ps"), F.flatten(F.transform("args", lambda x: x["below"])).alias("below"), F.exists("args", lambda x: x["twice"]).alias("twice"))
        value = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda j: one(F.transform("ps", lambda x: F.get(x, j)))) if points else one(F.col("ps"))
        twice = F.col("twice") | (F.size("below") > MOST_BELOW) | (F.size(F.array_distinct("below")) < F.size("below"))
        got = got.select(F.col("gate_id").alias("id"), value.alias("p"), F.when(twice, none).otherwise(F.col("below")).alias("below"), twice.alias("twice"), F.lit(GATE).alias("kind"), *([down(F.col("ps")).alias("slopes")] if slopes else []))
        done = done.unionByName(rounds.save(got))
    last = rounds.n
    out = rounds.save(done.drop("below"))
    rounds.drop(*range(1, last + 1))
    return out


def _accepts(connective: Column, n: Column, low: Column, high: Column) -> Column:
    """For every number of true arguments from 0 to ``n``, whether the gate is true; imply comes as an or."""
    nothing = F.lit(None).cast("boolean")
    return F.transform(F.sequence(F.lit(0), n), lambda t: formulas.truth(connective, t, n, nothing, nothing, low, high))


@dataclass
class Cores:
    """The parts of the graph under each root that need diagrams: ``programs`` root, gates, vars; ``single`` id, p, kind of the roots that need none."""

    programs: DataFrame
    single: DataFrame
    whole: DataFrame  # of all the graph, as ``independent`` gives it
    kinds: DataFrame  # (id, kind) of what is below roots that need diagrams
    reached: DataFrame  # (root, gate)


def cores(g: Graph, roots: DataFrame, rounds: graphs.Rounds, slopes: bool = False) -> Cores:
    """``roots``: id of gates, of a graph whose tables are written; ``slopes`` as for ``independent``."""
    edges = g.edges if "_saved_rows" in g.edges.__dict__ else rounds.save(g.edges)
    placed, left = graphs.levels(edges, distinct=True)
    if not left.isEmpty():
        raise CycleError("gates refer to themselves")
    whole = independent(g, placed, slopes=slopes)
    asked = rounds.save(roots.select("id").distinct().join(whole.drop("slopes"), "id", "left"))
    # roots below which nothing can be shared need no look at what they reach; of the tables only what the others reach goes on
    open_ = asked.where("twice").select(F.col("id").alias("start"))
    reached = rounds.save(graphs.reach(open_, edges).select(F.col("start").alias("root"), F.col("node").alias("gate_id")))
    g = g.below(reached, rounds)
    reached = rounds.save(reached.join(g.gates.select(F.col("id").alias("gate_id")), "gate_id", "left_semi"))
    levels = rounds.save(graphs.only(placed.select(F.col("node").alias("gate_id"), "level"), reached, "gate_id"))
    alone = rounds.save(graphs.only(whole.select("id", "p", "kind"), g.args.select(F.col("arg_id").alias("id")), "id"))
    inside = rounds.save(reached.join(g.args, "gate_id"))
    # what is referred to more than once under a root makes all gates above it parts of the root's core
    shared = inside.where(~F.col("arg_id").isin(TRUE, FALSE)).groupBy("root", "arg_id").agg(F.count("*").alias("n")).where("n > 1")
    name = lambda node: F.concat("root", F.lit(MARK), node)
    marked = inside.join(shared.select("root", "arg_id"), ["root", "arg_id"]).select(name("gate_id").alias("node")).distinct()
    own_edges = inside.join(g.gates.select(F.col("id").alias("arg_id")), "arg_id", "left_semi").select(name("gate_id").alias("a"), name("arg_id").alias("b"))
    core = graphs.reaching(marked, own_edges)
    core = reached.join(core.withColumnRenamed("node", "_name"), name("gate_id") == F.col("_name")).join(levels, "gate_id", "left").fillna(0, ["level"])
    core = rounds.save(core.withColumn("at", F.row_number().over(Window.partitionBy("root").orderBy("level", "gate_id")) - 1).select("root", "gate_id", "at"))
    kinds = g.gates.select(F.col("id").alias("gate_id"), F.when(F.col("connective") == "imply", "or").otherwise(F.col("connective")).alias("connective"), (F.col("connective") == "imply").alias("imply"), "min_num", "max_num")
    args = inside.join(core, ["root", "gate_id"]).join(core.select("root", F.col("gate_id").alias("arg_id"), F.col("at").alias("of")), ["root", "arg_id"], "left").join(kinds.select("gate_id", "imply"), "gate_id")
    args = rounds.save(args.withColumn("complement", F.col("complement") != (F.col("imply") & (F.col("ordinal") == 0))))
    variables = args.where("of IS NULL").groupBy("root", "arg_id").agg(F.min(F.struct("at", "ordinal")).alias("first")).join(alone.select(F.col("id").alias("arg_id"), "p"), "arg_id", "left")
    variables = rounds.save(variables.withColumn("place", F.row_number().over(Window.partitionBy("root").orderBy("first", "arg_id")) - 1).select("root", "arg_id", "place", "p"))
    args = args.join(variables.select("root", "arg_id", "place"), ["root", "arg_id"], "left")
    args = args.groupBy("root", "gate_id", "at").agg(F.collect_list(F.struct(F.coalesce("of", -F.col("place") - 1).alias("i"), F.col("complement").alias("c"))).alias("args"))
    accepts = _accepts(F.col("connective"), F.size("args"), F.col("min_num"), F.col("max_num"))
    gates = args.join(kinds, "gate_id").select("root", F.struct("at", accepts.alias("accepts"), "args").alias("gate"))
    programs = gates.groupBy("root").agg(F.sort_array(F.collect_list("gate")).alias("gates")).join(variables.groupBy("root").agg(F.sort_array(F.collect_list(F.struct("place", F.col("arg_id").alias("id"), "p"))).alias("vars")), "root")
    programs = rounds.save(programs)
    single = asked.select("id", "p", "kind").join(programs.select(F.col("root").alias("id")), "id", "left_anti")
    return Cores(programs, single, whole, alone.select("id", "kind"), reached)


def _rest(gates: Column, known: Column) -> Column:
    """What is left of the gates when the first variables have the values ``known``: 'T' or 'F', or the undecided gates that matter with their numbers of true arguments."""

    def step(values: Column, gate: Column) -> Column:
        xs = F.transform(gate["args"], lambda x: F.when(x["i"] >= 0, F.get(values, x["i"])["v"]).otherwise(F.get(known, -x["i"] - 1)) != x["c"])
        true, open_ = F.size(F.filter(xs, lambda x: F.coalesce(x, F.lit(False)))), F.size(F.filter(xs, lambda x: x.isNull()))
        left = F.slice(gate["accepts"], true + 1, open_ + 1)
        value = F.when(F.forall(left, lambda x: x), True).when(~F.exists(left, lambda x: x), False)
        return F.concat(values, F.array(F.struct(value.alias("v"), true.alias("t"))))

    values = F.aggregate(gates, F.array().cast("array<struct<v:boolean,t:int>>"), step)

    def ask(found: Column, gate: Column) -> Column:
        below = F.transform(F.filter(gate["args"], lambda x: (x["i"] >= 0)), lambda x: x["i"])
        below = F.filter(below, lambda i: F.get(F.col("_values"), i)["v"].isNull())
        return F.when(F.array_contains(found, gate["at"]), F.array_union(found, below)).otherwise(found)

    matter = F.aggregate(F.reverse(gates), F.array(F.size(gates) - 1), ask)
    text = F.array_join(F.transform(F.array_sort(matter), lambda i: F.concat(i.cast("string"), F.lit(":"), F.get(F.col("_values"), i)["t"].cast("string"))), ",")
    return values, F.when(F.element_at("_values", -1)["v"], "T").when(~F.element_at("_values", -1)["v"], "F").otherwise(text)


def _with_rest(rows: DataFrame, known: Column, name: str) -> DataFrame:
    values, text = _rest(F.col("gates"), known)
    return rows.withColumn("_values", values).withColumn(name, text).drop("_values")


def _layers(c: Cores, rounds: graphs.Rounds) -> tuple[DataFrame, list[DataFrame]]:
    """(root, p) of the roots with diagrams, and the layers of the diagrams: root, rest, id, p, w, low, high."""
    none = F.array().cast("array<boolean>")
    state = _with_rest(c.programs.select("root", "gates"), none, "rest").select("root", "rest", none.alias("known"), F.lit(1.0).alias("w"))
    state, layers, ended, depth = rounds.save(state), [], None, 0
    while True:
        done = state.where("rest = 'T'").select("root", "w")
        ended = done if ended is None else ended.unionByName(done)
        state = state.where("rest NOT IN ('T', 'F')")
        if state.isEmpty():
            break
        rows = state.join(c.programs, "root").withColumn("var", F.get("vars", F.lit(depth)))
        rows = _with_rest(_with_rest(rows, F.concat("known", F.array(F.lit(False))), "low"), F.concat("known", F.array(F.lit(True))), "high")
        rows = rows.select("root", "rest", "known", "w", F.col("var.id").alias("id"), F.col("var.p").alias("p"), "low", "high")
        layers.append(rounds.save(rows))
        rows = layers[-1]
        down = rows.select("root", F.col("low").alias("rest"), F.concat("known", F.array(F.lit(False))).alias("known"), (F.col("w") * (1 - F.col("p"))).alias("w"))
        up = rows.select("root", F.col("high").alias("rest"), F.concat("known", F.array(F.lit(True))).alias("known"), (F.col("w") * F.col("p")).alias("w"))
        state = rounds.save(down.unionByName(up).groupBy("root", "rest").agg(F.min("known").alias("known"), F.sum("w").alias("w")))
        depth += 1
    unknown = c.programs.where(F.exists("vars", lambda v: v["p"].isNull())).select("root")
    sums = c.programs.select("root").join(ended.groupBy("root").agg(F.sum("w").alias("p")), "root", "left").fillna(0.0, ["p"])
    return rounds.save(sums.join(unknown.withColumn("unknown", F.lit(True)), "root", "left").select("root", F.when(F.col("unknown").isNull(), F.col("p")).alias("p"))), layers


def probabilities(g: Graph, roots: DataFrame) -> DataFrame:
    """(id, p) of the gates ``roots`` (id), exact; null where an event below has no probability."""
    rounds = graphs.Rounds(g.gates.sparkSession)
    g = g.saved(rounds)
    c = cores(g, roots, rounds)
    found, _ = _layers(c, rounds)
    return c.single.select("id", "p").unionByName(found.select(F.col("root").alias("id"), "p"))


def at_points(g: Graph, points: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, point, p) of ``roots`` (id), exact, once for each point of ``points`` (id, point, p), which has all events at all points.

    All points of a gate go together; only below roots that may share something gates are repeated for each point.
    """
    rounds = graphs.Rounds(g.gates.sparkSession)
    each = [r[0] for r in points.select("point").distinct().orderBy("point").collect()]  # as many as the settings ask for
    if not each:
        return roots.select("id", F.lit(None).cast(dict(points.dtypes)["point"]).alias("point"), F.lit(None).cast("double").alias("p")).where("false")
    at = F.array(*map(F.lit, each))
    rows = points.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("point", "p"))).alias("all"))
    whole = F.transform("all", lambda x: x["p"])
    by_point = F.transform(at, lambda at_: F.get(F.filter("all", lambda x: x["point"] == at_), 0)["p"])
    g = Graph(g.gates, g.args, rows.select("id", F.when(F.size("all") == len(each), whole).otherwise(by_point).alias("p")), g.flat, g.links).saved(rounds)
    placed, left = graphs.levels(g.edges)
    if not left.isEmpty():
        raise CycleError("gates refer to themselves")
    found = rounds.save(roots.select("id").distinct().join(independent(g, placed, len(each)), "id", "left"))
    p = F.coalesce("p", F.array_repeat(F.lit(None).cast("double"), len(each)))
    alone = found.where("NOT coalesce(twice, false)").select("id", F.explode(F.arrays_zip(at.alias("point"), p.alias("p"))).alias("x")).select("id", "x.point", "x.p")
    shared = rounds.save(found.where("twice").select("id"))
    return alone if graphs.empty(shared) else alone.unionByName(_repeated(g, points, shared, rounds))


def _repeated(g: Graph, points: DataFrame, roots: DataFrame, rounds: graphs.Rounds) -> DataFrame:
    """``at_points`` with all gates below the roots once for each point."""
    each = rounds.save(points.select("point").distinct())
    own = lambda c: F.concat(F.col("point").cast("string"), F.lit(MARK), c)
    needed = graphs.reach(roots.select(F.col("id").alias("start")).distinct(), g.edges).select(F.col("node").alias("id")).distinct()
    gates = g.gates.join(needed, "id", "left_semi").crossJoin(each)
    args = g.args.join(needed.withColumnRenamed("id", "gate_id"), "gate_id", "left_semi").crossJoin(each)
    fixed = F.col("arg_id").isin(TRUE, FALSE)
    many = Graph(
        gates.select(own("id").alias("id"), "connective", "min_num", "max_num"),
        args.select(own("gate_id").alias("gate_id"), "ordinal", F.when(fixed, F.col("arg_id")).otherwise(own("arg_id")).alias("arg_id"), "complement"),
        points.select(own("id").alias("id"), "p"),
    ).saved(rounds)
    found = probabilities(many, roots.select("id").distinct().crossJoin(each).select(own("id").alias("id")))
    return found.select(F.substring_index("id", MARK, -1).alias("id"), F.substring_index("id", MARK, 1).cast(dict(points.dtypes)["point"]).alias("point"), "p")


def derivatives(g: Graph, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(root, id, birnbaum, p) of all events under each root, and (id, p) of the roots.

    Diagrams are gone through from their last layer to the first; below single variables that are gates, and in roots
    without diagrams, derivatives go down level by level.
    """
    rounds = graphs.Rounds(g.gates.sparkSession)
    g = g.saved(rounds)
    c = cores(g, roots, rounds, slopes=True)
    sums, layers = _layers(c, rounds)
    value = c.programs.select("root", F.explode(F.array(F.struct(F.lit("T").alias("rest"), F.lit(1.0).alias("v")), F.struct(F.lit("F").alias("rest"), F.lit(0.0).alias("v")))).alias("x")).select("root", "x.*")
    ends, found = value, None
    for layer in reversed(layers):
        side = lambda name: value.select("root", F.col("rest").alias(name), F.col("v").alias(f"v_{name}"))  # noqa: B023, E731
        rows = rounds.save(layer.join(side("low"), ["root", "low"]).join(side("high"), ["root", "high"]))
        here = rows.groupBy("root", "id").agg(F.sum(F.col("w") * (F.col("v_high") - F.col("v_low"))).alias("d"), F.max("p").alias("p"))
        found = here if found is None else found.unionByName(here)
        value = rows.select("root", "rest", (F.col("p") * F.col("v_high") + (1 - F.col("p")) * F.col("v_low")).alias("v")).unionByName(ends)
    front = c.single.select(F.col("id").alias("root"), "id", F.lit(1.0).alias("d"), "p", "kind")
    front = rounds.save(front if found is None else front.unionByName(found.join(c.kinds, "id", "left").select(*front.columns)))
    below = c.whole.where(F.col("kind") == GATE).select(F.col("id").alias("gate_id"), "slopes")
    reached = front.where(F.col("kind") == EVENT)
    while not graphs.empty(gates := front.where(F.col("kind") == GATE)):  # events and constants lead no further
        steps = gates.select("root", F.col("id").alias("gate_id"), "d").join(below, "gate_id").select("root", "d", F.explode("slopes").alias("x"))
        front = rounds.save(steps.select("root", "x.id", (F.col("d") * F.col("x.slope")).alias("d"), "x.p", "x.kind").where(F.col("kind").isin(EVENT, GATE)))
        reached = reached.unionByName(front.where(F.col("kind") == EVENT))
    # what follows joins by roots as well
    events = reached.repartition("root").groupBy("root", "id").agg(F.sum("d").alias("birnbaum"), F.max("p").alias("p"))
    whole = c.single.select("id", "p").unionByName(sums.select(F.col("root").alias("id"), "p"))
    return events, whole


def importance(g: Graph, roots: DataFrame) -> DataFrame:
    """(root, id, p, birnbaum, critical, diagnosis, achievement, reduction) of all events under each root; null where the root's probability is 0."""
    events, whole = derivatives(g, roots)
    rows = events.join(whole.select(F.col("id").alias("root"), F.col("p").alias("total")), "root")
    over = lambda x: F.try_divide(x, F.col("total"))
    achievement = over(F.col("total") + (1 - F.col("p")) * F.col("birnbaum"))
    return rows.select("root", "id", "p", "birnbaum", over(F.col("birnbaum") * F.col("p")).alias("critical"), (F.col("p") * achievement).alias("diagnosis"), achievement.alias("achievement"), F.try_divide(F.col("total"), F.col("total") - F.col("p") * F.col("birnbaum")).alias("reduction"))


def model_probabilities(model: Model, roots: DataFrame | None = None) -> DataFrame:
    """(id, p), exact, of the top gates of a model, or of ``roots`` (id), house events as declared; with ``preprocessor`` gates are made fewer first."""
    roots = (roots if roots is not None else model.top_events.select(F.col("gate_id").alias("id"))).select("id").distinct().withColumn("scenario", F.lit(""))
    g, placed = in_states(graph(model, roots=roots), model.house_events, roots)
    if model.settings.preprocessor:
        from . import simplify

        return simplify.probabilities(g, placed.select("id"))
    return probabilities(g, placed.select("id"))


def phase_probabilities(model: Model, roots: DataFrame | None = None) -> DataFrame:
    """(alignment, phase, fraction, id, p): top gates in every phase, with the house events as it sets them, exact."""
    roots = (roots if roots is not None else model.top_events.select(F.col("gate_id").alias("id"))).select("id").distinct()
    phases = model.phases.select("alignment", "phase", "fraction", F.concat("alignment", F.lit("/"), "phase").alias("scenario"))
    states = model.phase_house_events.select(F.concat("alignment", F.lit("/"), "phase").alias("scenario"), "house_event", "state")
    g, placed = in_states(graph(model, roots=roots), model.house_events, roots.crossJoin(phases.select("scenario")), states)
    p = probabilities(g, placed.select(F.col("gate").alias("id")).distinct()).withColumnRenamed("id", "gate")
    by_phase = placed.join(p, "gate").join(phases, "scenario").select("alignment", "phase", "fraction", "id", "p")
    return graphs.Rounds(g.gates.sparkSession).save(by_phase)


def over_phases(by_phase: DataFrame) -> DataFrame:
    """(alignment, id, p): the phases' probabilities weighted by their share of the time."""
    return by_phase.groupBy("alignment", "id").agg(F.sum(F.col("p") * F.col("fraction")).alias("p"))
