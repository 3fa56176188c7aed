"""Evaluation: expressions bottom-up by level, their domains and samples; gates bottom-up by level.

Every level is one join and one aggregation over all its nodes, whatever models they belong to; results of a level go to
the shared folder, so lineage does not grow with depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import deviates, intervals, lifetime, numeric
from ..operators import ccf, elements, formulas, graphs
from .model import CCF_EVENTS, Model

FOLDS = ("add", "sub", "mul", "div", "min", "max", "and", "or")


def _arg(args: Column, i: int) -> Column:
    return F.get(args, F.lit(i))


def _step(name: str):
    return lambda a, x: numeric.apply(name, a, x)


def _domain_step(name: str):
    def step(a: Column, x: Column) -> Column:
        out = intervals.propagate(name, intervals.Interval(a["lo"], a["hi"]), intervals.Interval(x["lo"], x["hi"]))
        return F.struct(out.lo.alias("lo"), out.hi.alias("hi"))

    return step


def _value(op: Column, args: Column, ref: Column | None = None, registry=None) -> Column:
    """The value of a node from the array of its arguments' values, by its operator; ``ref`` names an external function of the registry."""
    rest = F.slice(args, F.lit(2), F.greatest(F.size(args) - 1, F.lit(0)))
    out = F.when(op == "mean", F.aggregate(args, F.lit(0.0), lambda a, x: a + x) / F.size(args))
    for name in FOLDS:
        out = out.when(op == name, F.aggregate(rest, _arg(args, 0), _step(name)))
    for name, (least, most, _) in numeric.OPERATORS.items():
        if most is not None:
            out = out.when(op == name, numeric.apply(name, *[_arg(args, i) for i in range(least)]))
    n = F.size(args)
    hit = F.filter(F.sequence(F.lit(0), F.greatest(F.floor(n / 2).cast("int") - 1, F.lit(0))), lambda i: (2 * i + 1 < n) & (F.get(args, 2 * i) != 0))
    out = out.when(op == "switch", F.coalesce(F.get(args, 2 * F.get(hit, F.lit(0)) + 1), F.element_at(args, -1)))
    for law, (count, f) in lifetime.LAWS.items():
        name = law.partition("/")[0]
        out = out.when((op == name) & (n == count), f(*[_arg(args, i) for i in range(count)]))
    a, b = _arg(args, 0), _arg(args, 1)
    out = out.when(op == "uniform-deviate", (a + b) / 2).when(op == "normal-deviate", a)
    out = out.when((op == "lognormal-deviate") & (n == 3), a).when(op == "lognormal-deviate", F.exp(a + b * b / 2))
    out = out.when(op == "gamma-deviate", a * b).when(op == "beta-deviate", a / (a + b))
    out = out.when(op == "histogram", _histogram_mean(args))
    for name, (_, signature) in registry.known.items() if registry else ():
        out = out.when((op == "extern-function") & (ref == name), registry.call(name, *[_arg(args, i) for i in range(len(signature.parameters))]))
    return out


def _problem(op: Column, args: Column, lo: Column, hi: Column) -> Column:
    """What is wrong with the values and domains of a node's arguments; null if nothing."""
    n = F.size(args)
    pick = lambda i: intervals.Interval(F.get(lo, F.lit(i)), F.get(hi, F.lit(i)))
    below = lambda i: (_arg(args, i) < 0) | ~pick(i).is_non_negative()
    not_above = lambda i: (_arg(args, i) <= 0) | ~pick(i).is_positive()
    no_chance = lambda i: (_arg(args, i) < 0) | (_arg(args, i) > 1) | ~pick(i).is_probability()
    ranges = F.slice(F.arrays_zip(lo.alias("lo"), hi.alias("hi")), F.lit(2), F.greatest(n - 1, F.lit(0)))
    out = F.when((op == "div") & F.exists(ranges, lambda r: (r["lo"] <= 0) & (r["hi"] >= 0)), "division by zero")
    for name, (least, _, _) in numeric.OPERATORS.items():
        if name != "div" and (bad := intervals.domain_problem(name, *[pick(i) for i in range(least)])) is not None:
            out = out.when((op == name) & bad, "argument outside the operator's domain")
    rates = {"exponential": below(0) | below(1), "GLM": no_chance(0) | not_above(1) | below(2) | below(3), "Weibull": not_above(0) | not_above(1) | below(2) | below(3)}
    for name, bad in rates.items():
        out = out.when((op == name) & bad, "argument outside the law's domain")
    out = out.when((op == "periodic-test") & (n == 4) & (not_above(0) | not_above(1) | below(2) | below(3)), "argument outside the law's domain")
    out = out.when((op == "periodic-test") & (n == 5) & (not_above(0) | below(1) | not_above(2) | below(3) | below(4)), "argument outside the law's domain")
    full = not_above(0) | below(1) | below(2) | not_above(3) | below(4) | no_chance(5) | not_above(6) | (_arg(args, 6) > _arg(args, 3)) | no_chance(8) | no_chance(9) | below(10)
    out = out.when((op == "periodic-test") & (n == 11) & full, "argument outside the law's domain")
    out = out.when((op == "uniform-deviate") & (_arg(args, 0) >= _arg(args, 1)), "minimum not below maximum").when((op == "normal-deviate") & (_arg(args, 1) <= 0), "deviation not positive")
    level = _arg(args, 2)
    out = out.when((op == "lognormal-deviate") & (n == 3) & ((_arg(args, 0) <= 0) | (_arg(args, 1) <= 0) | (level <= 0) | (level >= 1)), "mean, error factor or level outside its range")
    out = out.when((op == "lognormal-deviate") & (n == 2) & (_arg(args, 1) <= 0), "deviation not positive")
    out = out.when(op.isin("gamma-deviate", "beta-deviate") & ((_arg(args, 0) <= 0) | (_arg(args, 1) <= 0)), "shape or scale not positive")
    bounds, weights = _histogram(args)
    rising = F.forall(F.sequence(F.lit(1), F.greatest(F.size(bounds) - 1, F.lit(1))), lambda i: F.get(bounds, i) > F.get(bounds, i - 1))
    return out.when((op == "histogram") & (~rising | F.exists(weights, lambda w: w < 0)), "bounds not rising or weights negative")


def _histogram(args: Column) -> tuple[Column, Column]:
    """Bounds and weights: the first bound, then (bound, weight) by turns."""
    bins = F.sequence(F.lit(1), F.greatest(F.floor((F.size(args) - 1) / 2).cast("int"), F.lit(1)))
    bounds = F.concat(F.array(_arg(args, 0)), F.transform(bins, lambda i: F.get(args, 2 * i - 1)))
    return bounds, F.transform(bins, lambda i: F.get(args, 2 * i))


def _histogram_mean(args: Column) -> Column:
    bounds, weights = _histogram(args)
    sums = F.transform(weights, lambda w, i: w * (F.get(bounds, i) + F.get(bounds, i + 1)) / 2)
    add = lambda a, x: a + x
    return F.aggregate(sums, F.lit(0.0), add) / F.aggregate(weights, F.lit(0.0), add)


def _sample(op: Column, args: Column, seed: int, trial: Column, node: Column) -> Column:
    """A draw of a deviate, keyed by (seed, trial, node)."""
    u, w = (deviates.keyed_uniform(seed, trial, node, stream=s) for s in ("1", "2"))
    z, a, b, n = deviates.standard_normal(u, w), _arg(args, 0), _arg(args, 1), F.size(args)
    sigma = F.ln(b) / deviates.normal_quantile(_arg(args, 2))  # of mean, error factor and level
    bounds, weights = _histogram(args)
    total = F.aggregate(weights, F.lit(0.0), lambda s, x: s + x)
    sums = F.transform(weights, lambda _, i: F.aggregate(F.slice(weights, F.lit(1), i + 1), F.lit(0.0), lambda s, x: s + x))
    at = F.size(F.filter(sums, lambda s: s <= u * total))
    drawn = F.get(bounds, at) + w * (F.get(bounds, at + 1) - F.get(bounds, at))
    key = F.pmod(F.xxhash64(node), F.lit(1 << 31))
    return (
        F.when(op == "uniform-deviate", deviates.uniform(u, a, b)).when(op == "normal-deviate", deviates.normal(z, a, b))
        .when((op == "lognormal-deviate") & (n == 3), deviates.lognormal(z, F.ln(a) - sigma * sigma / 2, sigma)).when(op == "lognormal-deviate", deviates.lognormal(z, a, b))
        .when(op == "gamma-deviate", deviates.gamma(F.lit(seed), trial, key, F.when(op == "gamma-deviate", a).otherwise(1.0), F.when(op == "gamma-deviate", b).otherwise(1.0)))
        .when(op == "beta-deviate", deviates.beta(F.lit(seed), trial, key, F.when(op == "beta-deviate", a).otherwise(1.0), F.when(op == "beta-deviate", b).otherwise(1.0)))
        .when(op == "histogram", drawn)
    )


def _domain(op: Column, lo: Column, hi: Column, args: Column) -> Column:
    """(lo, hi) of a node from its arguments' domains."""
    pick = lambda i: intervals.Interval(F.get(lo, F.lit(i)), F.get(hi, F.lit(i)))
    as_struct = lambda iv: F.struct(iv.lo.alias("lo"), iv.hi.alias("hi"))
    pairs = F.arrays_zip(lo.alias("lo"), hi.alias("hi"))
    rest = F.slice(pairs, F.lit(2), F.greatest(F.size(pairs) - 1, F.lit(0)))
    first = F.struct(F.get(lo, F.lit(0)).alias("lo"), F.get(hi, F.lit(0)).alias("hi"))
    out = F.when(op == "mean", F.struct((F.aggregate(lo, F.lit(0.0), lambda a, x: a + x) / F.size(lo)).alias("lo"), (F.aggregate(hi, F.lit(0.0), lambda a, x: a + x) / F.size(hi)).alias("hi")))
    for name in FOLDS:
        out = out.when(op == name, F.aggregate(rest, first, _domain_step(name)))
    for name, (least, most, _) in numeric.OPERATORS.items():
        if most is not None:
            out = out.when(op == name, as_struct(intervals.propagate(name, *[pick(i) for i in range(least)])))
    odd = F.filter(pairs, lambda _, i: (i % 2 == 1) | (i == F.size(pairs) - 1))
    out = out.when(op == "switch", F.struct(F.array_min(F.transform(odd, lambda x: x["lo"])).alias("lo"), F.array_max(F.transform(odd, lambda x: x["hi"])).alias("hi")))
    a, b = _arg(args, 0), _arg(args, 1)
    out = out.when(op == "uniform-deviate", F.struct(a.alias("lo"), b.alias("hi"))).when(op == "normal-deviate", F.struct((a - 6 * b).alias("lo"), (a + 6 * b).alias("hi")))
    bounds, _ = _histogram(args)
    out = out.when(op == "histogram", F.struct(_arg(bounds, 0).alias("lo"), F.element_at(bounds, -1).alias("hi")))
    far = F.struct(F.lit(0.0).alias("lo"), F.lit(float("inf")).alias("hi"))
    out = out.when(op.isin("lognormal-deviate", "gamma-deviate"), far)
    return out.otherwise(F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi")))  # laws and beta deviates


def _links(model: Model) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): nodes with a key and operator; edges from a node to its arguments in order.

    Bins and cases dissolve into their arguments; a parameter's node has the parameter's root as its argument.
    """
    key = F.concat_ws("#", "file", "node")
    e = model.expressions.withColumn("key", key)
    pairs = e.where("tag IN ('bin', 'case')").select("file", F.col("node").alias("parent"), F.col("parent").alias("over"), F.col("ordinal").alias("before"))
    plain = e.where("tag NOT IN ('bin', 'case')")
    up = plain.join(pairs, ["file", "parent"], "left")
    edges = up.select(F.concat_ws("#", "file", F.coalesce("over", "parent")).alias("a"), F.coalesce("before", "ordinal").alias("o1"), F.when(F.col("over").isNotNull(), F.col("ordinal")).otherwise(-1).alias("o2"), F.col("key").alias("b"))
    edges = edges.join(plain.select(F.col("key").alias("a")), "a", "left_semi")
    roots = model.expression_roots.where("id LIKE 'parameter:%'").select(F.substring("id", 11, 1 << 20).alias("parameter_id"), F.concat_ws("#", "file", "root").alias("b"))
    through = plain.where("parameter_id IS NOT NULL").join(roots, "parameter_id").select(F.col("key").alias("a"), F.lit(0).alias("o1"), F.lit(-1).alias("o2"), "b")
    return plain.select("key", "tag", "literal", "ref", "state"), edges.unionByName(through)


def expressions(model: Model, trials: int = 0, seed: int | None = None, context: dict | None = None, times: list[float] | None = None) -> DataFrame:
    """(key, value, lo, hi, deviate, tag, problem) of all expression nodes; with ``trials``, (key, trial, value): one keyed draw of each
    deviate a trial, shared by all that refer to it.

    ``context``: ``{"ie": name, "fe": {functional event: state}}`` for the test expressions; sampled, these are 0.
    ``times``: instead of draws, (key, trial, value) at each of these mission times, ``trial`` their place.
    """
    spark = model.nodes.sparkSession
    rounds = graphs.Rounds(spark)
    nodes, edges = _links(model)
    nodes, edges = rounds.save(nodes), rounds.save(edges)
    placed, _ = graphs.levels(edges.select("a", "b"))
    leveled = rounds.save(nodes.join(placed.select(F.col("node").alias("key"), "level"), "key", "left").fillna(0, ["level"]))
    context = context or {}
    fe = F.create_map(*[F.lit(x) for kv in context.get("fe", {}).items() for x in kv]) if context.get("fe") else F.create_map().cast("map<string,string>")
    leaf = (
        F.when(F.col("tag") == "system-mission-time", F.lit(model.settings.mission_time))
        .when(F.col("tag") == "test-initiating-event", F.lit(0.0) if trials else numeric.number(F.coalesce(F.col("ref") == F.lit(context.get("ie")), F.lit(False))))
        .when(F.col("tag") == "test-functional-event", F.lit(0.0) if trials else numeric.number(F.coalesce(fe[F.col("ref")] == F.col("state"), F.lit(False))))
        .otherwise(F.col("literal"))
    )
    for name, (_, signature) in model.functions.known.items():
        if not signature.parameters:
            leaf = F.when((F.col("tag") == "extern-function") & (F.col("ref") == name), model.functions.call(name)).otherwise(leaf)
    seed = model.settings.seed if seed is None else seed
    trials = len(times) if times else trials
    own = [F.col("trial")] if trials else []
    base = leveled.where("level = 0").select("key", leaf.alias("value"), "tag")
    if trials:
        base = base.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
        if times:
            base = base.withColumn("value", F.when(F.col("tag") == "system-mission-time", F.get(F.array(*map(F.lit, times)), F.col("trial"))).otherwise(F.col("value")))
        done = rounds.save(base.select("key", "trial", "value"))
    else:
        lo = F.when(F.col("tag") == "system-mission-time", 0.0).when(F.col("tag").startswith("test-"), 0.0).otherwise(F.col("value"))
        hi = F.when(F.col("tag").startswith("test-"), 1.0).otherwise(F.col("value"))
        done = rounds.save(base.select("key", "value", lo.alias("lo"), hi.alias("hi"), F.lit(False).alias("deviate"), "tag", F.lit(None).cast("string").alias("problem")))
    top = leveled.agg(F.max("level")).first()[0] or 0
    for level in range(1, top + 1):
        here = leveled.where(F.col("level") == level).select(F.col("key").alias("a"), "tag", "ref")
        columns = ["value"] if trials else ["value", "lo", "hi", "deviate"]
        got = here.join(edges, "a").join(done.select(F.col("key").alias("b"), *own, *columns), "b")
        order = F.sort_array(F.collect_list(F.struct("o1", "o2", *columns)))
        got = got.groupBy("a", "tag", "ref", *own).agg(order.alias("args"))
        take = lambda c: F.transform("args", lambda x: x[c])
        op, args = F.col("tag"), F.col("v")
        got = got.withColumn("v", take("value"))
        value = F.when(op == "parameter", _arg(args, 0)).otherwise(_value(op, args, F.col("ref"), model.functions))
        if trials:
            got = got.withColumn("drawn", F.lit(None).cast("double") if times else _sample(op, args, seed, F.col("trial"), F.col("a")))
            found = got.select(F.col("a").alias("key"), "trial", F.coalesce("drawn", value).alias("value"))
        else:
            got = got.withColumns({"los": take("lo"), "his": take("hi")})
            domain = F.when(op == "parameter", F.struct(_arg(F.col("los"), 0).alias("lo"), _arg(F.col("his"), 0).alias("hi"))).otherwise(_domain(op, F.col("los"), F.col("his"), args))
            deviate = op.endswith("-deviate") | (op == "histogram") | F.exists("args", lambda x: x["deviate"])
            domain = F.when(op == "extern-function", F.struct(value.alias("lo"), value.alias("hi"))).otherwise(domain)
            problem = _problem(op, args, F.col("los"), F.col("his"))
            found = got.select(F.col("a").alias("key"), value.alias("value"), domain.alias("d"), deviate.alias("deviate"), "tag", problem.alias("problem")).select("key", "value", "d.lo", "d.hi", "deviate", "tag", "problem")
        done = done.unionByName(rounds.save(found))
    return done


class Contextual:
    """Expressions that test initiating or functional events: their values in many contexts at once; the others' values once."""

    def __init__(self, model: Model, rounds: graphs.Rounds):
        """Nothing is evaluated anew for models without such tests."""
        self.model, self.rounds = model, rounds
        self.values = rounds.save(expressions(model).select("key", "value"))
        tests = model.expressions.where("tag IN ('test-initiating-event', 'test-functional-event')").select(F.concat_ws("#", "file", "node").alias("node"))
        self.none = tests.isEmpty()
        if self.none:
            self.dependent = rounds.save(tests)
            return
        nodes, edges = _links(model)
        self.edges = rounds.save(edges)
        self.dependent = rounds.save(graphs.reaching(tests, self.edges.select("a", "b").distinct()))
        inside = self.edges.join(self.dependent.withColumnRenamed("node", "a"), "a", "left_semi").join(self.dependent.withColumnRenamed("node", "b"), "b", "left_semi").select("a", "b").distinct()
        inside = rounds.save(inside)
        placed, _ = graphs.levels(inside)
        leveled = nodes.join(self.dependent.withColumnRenamed("node", "key"), "key", "left_semi").join(placed.select(F.col("node").alias("key"), "level"), "key", "left").fillna(0, ["level"])
        self.leveled = rounds.save(leveled)
        self.top = self.leveled.agg(F.max("level")).first()[0] or 0
        self.inside = inside

    def evaluate(self, wanted: DataFrame, contexts: DataFrame) -> DataFrame:
        """(ctx, key, value) of ``wanted`` (ctx, key); ``contexts``: ctx, ie, fe (functional events to their states)."""
        plain = wanted.join(self.values, "key").select("ctx", "key", "value")
        if self.none:
            return plain
        rounds = self.rounds
        special = rounds.save(wanted.join(self.dependent.withColumnRenamed("node", "key"), "key", "left_semi").select("ctx", "key").distinct())
        if graphs.empty(special):
            return plain
        below = graphs.reach(special.select(F.col("key").alias("start")), self.inside).select(F.col("start").alias("key"), "node")
        needed = special.join(below, "key").select("ctx", F.col("node").alias("key")).distinct().join(self.leveled, "key")
        needed = rounds.save(needed)
        tested = needed.where("tag LIKE 'test-%'").join(contexts, "ctx")
        holds = F.when(F.col("tag") == "test-initiating-event", F.col("ie") == F.col("ref")).otherwise(F.element_at("fe", F.col("ref")) == F.col("state"))
        done = rounds.save(tested.select("ctx", "key", numeric.number(F.coalesce(holds, F.lit(False))).alias("value")))
        for level in range(self.top + 1):
            here = needed.where((F.col("level") == level) & ~F.col("tag").startswith("test-")).select("ctx", F.col("key").alias("a"), "tag", F.col("ref").alias("of"))
            args = here.join(self.edges, "a").join(self.values.select(F.col("key").alias("b"), F.col("value").alias("fixed")), "b", "left").join(done.select("ctx", F.col("key").alias("b"), "value"), ["ctx", "b"], "left")
            order = F.sort_array(F.collect_list(F.struct("o1", "o2", F.coalesce("value", "fixed").alias("value"))))
            got = args.groupBy("ctx", "a", "tag", "of").agg(F.transform(order, lambda x: x["value"]).alias("v"))
            value = F.when(F.col("tag") == "parameter", _arg(F.col("v"), 0)).otherwise(_value(F.col("tag"), F.col("v"), F.col("of"), self.model.functions))
            done = done.unionByName(rounds.save(got.select("ctx", F.col("a").alias("key"), value.alias("value"))))
        return plain.join(special, ["ctx", "key"], "left_anti").unionByName(done.join(special, ["ctx", "key"], "left_semi"))


def _of_events(model: Model, values: DataFrame) -> DataFrame:
    roots = model.expression_roots.where("id LIKE 'event:%'").select(F.substring("id", 7, 1 << 20).alias("id"), F.concat_ws("#", "file", "root").alias("key"))
    return roots.join(values, "key").drop("key").withColumnRenamed("value", "p")


def event_probabilities(model: Model, **how) -> DataFrame:
    """(id, p, lo, hi, deviate) of basic events with an expression, or (id, trial, p) with ``trials``."""
    return _of_events(model, expressions(model, **how).drop("tag", "problem"))


def _groups(model: Model, values: DataFrame) -> DataFrame:
    """(group_id, model, n, q_total, level, factor) with the values of the distribution and the factor; with a trial where values have one."""
    own = [c for c in ("trial",) if c in values.columns]
    values = values.select("key", *own, "value")
    roots = model.expression_roots.where("id LIKE 'group:%'").select(F.substring("id", 7, 1 << 20).alias("group_id"), F.concat_ws("#", "file", "root").alias("key"))
    totals = roots.join(values, "key").select("group_id", *own, F.col("value").alias("q_total"))
    return model.ccf_levels.join(values.withColumnRenamed("value", "factor"), "key").join(totals, ["group_id", *own]).drop("key", "min_level")


def member_probabilities(model: Model, values: DataFrame) -> DataFrame:
    """(id, p) of the members of common-cause groups: an OR over the events that a member is in, of which those of a level
    are equally likely; so their number is enough."""
    groups = _groups(model, values)
    sizes = groups.select("group_id", "n").distinct()
    q = ccf.level_probabilities(groups).join(sizes, "group_id")
    none = F.pow(1 - F.col("q"), ccf.binomial(F.col("n") - 1, F.col("level") - 1))
    of_group = q.groupBy("group_id").agg(F.when(F.count_if(F.col("q").isNull()) == 0, F.product(none)).alias("none"))
    # a group without levels has no events: a member of it has no probability
    rows = model.ccf_members.select("group_id", F.col("event_id").alias("id")).distinct().join(of_group, "group_id")
    return rows.groupBy("id").agg(F.when(F.count_if(F.col("none").isNull()) == 0, 1 - F.product("none")).alias("p"))


def ccf_probabilities(model: Model, values: DataFrame, combined: DataFrame | None = None) -> DataFrame:
    """(id, p) of the events of common-cause groups, or of those ``combined``; (id, trial, p) where values have a trial."""
    combined = model.ccf_events if combined is None else combined
    if "trial" not in values.columns:
        q = ccf.level_probabilities(_groups(model, values))
        return combined.join(q, ["group_id", "level"]).select("id", F.col("q").alias("p"))
    # a group of one trial is a group of its own
    rows = _groups(model, values).withColumn("group_id", F.concat_ws("\u0001", "trial", "group_id")).drop("trial")
    q = ccf.level_probabilities(rows).select(F.substring_index("group_id", "\u0001", 1).cast("int").alias("trial"), F.substring_index("group_id", "\u0001", -1).alias("group_id"), "level", "q")
    return combined.join(q, ["group_id", "level"]).select("id", "trial", F.col("q").alias("p"))


def domain_violations(model: Model) -> DataFrame:
    """Expressions outside their operators' domains, events and factors that are no probabilities, phi factors that do not sum to 1."""
    v, stage = elements.violation, "4 evaluate"
    values = graphs.Rounds(model.nodes.sparkSession).save(expressions(model))
    bad = (F.col("p") < 0) | (F.col("p") > 1) | F.isnan("p") | (F.col("deviate") & (F.col("hi") < 0)) | (~F.col("deviate") & ((F.col("lo") < 0) | (F.col("hi") > 1)))
    p = _of_events(model, values).where(bad)
    keyed = model.expressions.select(F.concat_ws("#", "file", "node").alias("key"), "file", "line")
    broken = values.where("problem IS NOT NULL").join(keyed, "key")
    roots = model.expression_roots.where("id LIKE 'factor:%' OR id LIKE 'group:%'").select("id", F.concat_ws("#", "file", "root").alias("key"))
    parts = roots.join(values, "key").where("value < 0 OR value > 1 OR lo < 0 OR hi > 1")
    phi = model.ccf_levels.where("model = 'phi-factor'").join(values, "key").groupBy("group_id").agg(*[F.sum(c).alias(c) for c in ("value", "lo", "hi")])
    off = [~elements.close(F.lit(1.0), F.col(c), 1e-4) for c in ("value", "lo", "hi")]
    return elements.union([
        v(broken, stage, "DomainError", F.col("tag"), F.col("problem"), F.col("file"), F.col("line")).withColumn("code", F.when(F.col("entity").isin("uniform-deviate", "histogram"), "ValidityError").otherwise("DomainError")),
        v(parts, stage, "DomainError", F.col("id"), "distribution or factor is not a probability"),
        v(phi.where(off[0] | off[1] | off[2]), stage, "ValidityError", F.col("group_id"), "factors of a phi model must sum to 1"),
        v(p, stage, "DomainError", F.col("id"), "not a probability"),
    ])


def ccf_gates(model: Model) -> DataFrame:
    """(event_id, group_id, args): the gate, an OR over ``args``, that stands for each member of a common-cause group."""
    each = model.ccf_events.select("group_id", "id", F.explode("members").alias("event_id"))
    return each.groupBy("event_id", "group_id").agg(F.sort_array(F.collect_list("id")).alias("args"))


def needed_events(model: Model, roots: DataFrame | None = None) -> DataFrame:
    """The events of common-cause groups that matter below gates, and below ``roots`` (id): of groups with a member that a gate or root is over."""
    named = model.gate_args.where("arg_kind = 'basic-event'").select(F.col("arg_id").alias("event_id"))
    named = named if roots is None else named.unionByName(roots.select(F.col("id").alias("event_id")))
    # members are few beside arguments, so these are looked through without being dealt out
    which = graphs.Rounds(model.nodes.sparkSession).save(named.join(model.ccf_members.select("event_id", "group_id").distinct(), "event_id").select("group_id").distinct())
    if graphs.empty(which):
        return graphs.same_rows(model.nodes.sparkSession.createDataFrame([], CCF_EVENTS).where("false"), which)
    return model.combined(which)


def _applied(model: Model, combined: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(gates, args, edges) with every member of a common-cause group as an OR over the events that it is in; of those ``combined``, if given."""
    proxy = (model.ccf_events if combined is None else combined).select(F.explode("members").alias("gate_id"), F.col("id").alias("arg_id"))
    number = F.lit(None).cast("int")
    gates = model.gates.unionByName(proxy.select(F.col("gate_id").alias("id"), F.lit("or").alias("connective"), number.alias("min_num"), number.alias("max_num")).distinct())
    plain = model.gate_args.select("gate_id", "ordinal", "arg_id", "complement")
    args = plain.unionByName(proxy.select("gate_id", F.lit(0).alias("ordinal"), "arg_id", F.lit(False).alias("complement")))
    through = plain.select(F.col("gate_id").alias("a"), F.col("arg_id").alias("b")).join(proxy.select(F.col("gate_id").alias("b")).distinct(), "b", "left_semi").select("a", "b")
    return gates, args, model.gate_edges.unionByName(through).distinct()


def _base(model: Model, combined: DataFrame | None = None, **how) -> DataFrame:
    """(id, p) of basic events, members of common-cause groups replaced by the groups' events; (id, trial, p) with ``trials`` or ``times``."""
    values = graphs.Rounds(model.nodes.sparkSession).save(expressions(model, **how))
    events = _of_events(model, values).select("id", *[c for c in ("trial",) if c in values.columns], "p").join(model.ccf_members.select(F.col("event_id").alias("id")), "id", "left_anti")
    return events.unionByName(ccf_probabilities(model, values, combined))


def _by_level(gates: DataFrame, edges: DataFrame):
    """Gates with their levels, lowest first, and the highest level."""
    placed, _ = graphs.levels(edges)
    gates = gates.join(placed.select(F.col("node").alias("id"), "level"), "id", "left").fillna(0, ["level"])
    gates = graphs.Rounds(gates.sparkSession).save(gates)
    return gates, gates.agg(F.max("level")).first()[0]


def gate_probabilities(model: Model, events: DataFrame | None = None, combined: bool = True) -> DataFrame:
    """(id, p) of gates and events, arguments taken as independent: exact for models where no event is shared.

    Without ``combined`` the events of common-cause groups, one for each combination of members, are left out of the
    result; the members' probabilities, and all above, are the same.

    A gate over an argument without a probability has none either (null).
    """
    houses = model.house_events.select("id", F.col("state").cast("double").alias("p"))
    fixed = model.nodes.sparkSession.createDataFrame([("__true__", 1.0), ("__false__", 0.0)], "id string, p double")
    if events is None and not combined:
        values = graphs.Rounds(model.nodes.sparkSession).save(expressions(model))
        plain = _of_events(model, values).select("id", "p").join(model.ccf_members.select(F.col("event_id").alias("id")), "id", "left_anti")
        known = plain.unionByName(member_probabilities(model, values)).unionByName(houses).unionByName(fixed)
        return bottom_up(model.gates, model.gate_args.select("gate_id", "ordinal", "arg_id", "complement"), model.gate_edges, known)
    gates, args, edges = _applied(model)
    return bottom_up(gates, args, edges, (events if events is not None else _base(model)).select("id", "p").unionByName(houses).unionByName(fixed))


def bottom_up(gates: DataFrame, all_args: DataFrame, edges: DataFrame, known: DataFrame) -> DataFrame:
    """(id, p) of ``known`` and of gates over them, level by level, arguments taken as independent."""
    rounds = graphs.Rounds(gates.sparkSession)
    done = rounds.save(known)
    gates, top = _by_level(gates, edges)
    for level in range((top if top is not None else -1) + 1):
        here = gates.where(F.col("level") == level)
        args = all_args.join(here.withColumnRenamed("id", "gate_id"), "gate_id").join(done.withColumnRenamed("id", "arg_id"), "arg_id", "left")
        p = F.when(F.col("complement"), 1 - F.col("p")).otherwise(F.col("p"))
        got = args.groupBy("gate_id", "connective", "min_num", "max_num").agg(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", p.alias("p")))), lambda x: x["p"]).alias("ps"))
        value = F.when(~F.exists("ps", lambda x: x.isNull()), formulas.probability(F.col("connective"), F.col("ps"), F.col("min_num"), F.col("max_num")))
        got = got.select(F.col("gate_id").alias("id"), value.alias("p"))
        done = done.unionByName(rounds.save(got))
    return done


def simulate(model: Model, trials: int | None = None, seed: int | None = None, events: DataFrame | None = None) -> DataFrame:
    """(id, p, trials): the share of trials in which each gate occurs; shared events are drawn once a trial.

    A gate over an argument that is never drawn, for want of a probability, has none either (null).
    """
    trials, seed = trials or model.settings.num_trials, model.settings.seed if seed is None else seed
    rounds = graphs.Rounds(model.nodes.sparkSession)
    drawn = (events if events is not None else _base(model)).select("id", "p").withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    drawn = drawn.select("id", "trial", (deviates.keyed_uniform(seed, F.col("trial"), F.col("id")) < F.col("p")).alias("x"))
    fixed = model.nodes.sparkSession.createDataFrame([("__true__", True), ("__false__", False)], "id string, x boolean").unionByName(model.house_events.select("id", F.col("state").alias("x")))
    fixed = fixed.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1)))).select("id", "trial", "x")
    done = rounds.save(drawn.unionByName(fixed))
    gates, all_args, edges = _applied(model)
    gates, top = _by_level(gates, edges)
    for level in range((top if top is not None else -1) + 1):
        here = gates.where(F.col("level") == level)
        args = all_args.join(here.select(F.col("id").alias("gate_id")), "gate_id").withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
        args = args.join(done.withColumnRenamed("id", "arg_id"), ["arg_id", "trial"], "left")
        unknown = args.where("x IS NULL").select(F.col("gate_id").alias("id"), "trial", F.lit(True).alias("unknown")).distinct()
        got = formulas.evaluate(args, ["gate_id", "trial"]).withColumnRenamed("gate_id", "id").join(here, "id")
        x = formulas.truth(F.col("connective"), F.col("true_args"), F.col("n"), F.col("first"), F.col("second"), F.col("min_num"), F.col("max_num"))
        got = got.join(unknown, ["id", "trial"], "left").select("id", "trial", F.when(F.col("unknown").isNull(), x).alias("x"))
        done = done.unionByName(rounds.save(got))
    return done.join(gates.select("id"), "id", "left_semi").groupBy("id").agg(F.try_divide(F.count_if("x"), F.count("x")).alias("p"), F.count("x").alias("trials"))
