"""Products of the gates of a model: minimal cut sets, prime implicants, and substitutions applied to them.

Every gate, true or false, is a list of alternatives: sets of its arguments, each true or false, that decide it. All
connectives come down to choosing so many arguments to be true and so many others to be false. Open gates of all sets of a
round are replaced in one join; sets beyond the order or below the cut-off of the settings are left at once. Gates over
events only that have few alternatives need no rounds: their cut sets are made, and absorbed, within their row.

Literals are event ids, with ``!`` before those that must not occur. Without ``prime_implicants`` events that must not
occur count as certain not to, and products hold failures only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import CycleError
from ..operators import ccf, graphs, substitutions
from ..settings import Settings
from . import exact, quantify
from .model import Model

NOT = "!"
#: Sets that are made within the row of one gate, at most.
IN_ROW = 128


def _least(n: Column) -> Column:
    """How many true arguments make a gate of ``n`` true (or, of a negated one, false); null for gates that count in another way."""
    kind = F.col("connective")
    return F.when(kind.isin("and", "nand", "null", "not"), n).when(kind.isin("or", "nor", "imply"), 1).when(kind == "atleast", F.col("min_num"))


def _patterns(n: Column) -> Column:
    """(sign, ons, offs): how many arguments are true, and how many others false, in an alternative of a gate that is true, or is not."""
    kind, low, high = F.col("connective"), F.col("min_num"), F.col("max_num")
    flipped, least = kind.isin("nand", "nor", "not", "iff"), _least(n)
    of = lambda sign, true, false: F.struct(sign.alias("sign"), F.lit(true).cast("int").alias("ons"), F.lit(false).cast("int").alias("offs"))
    zero = F.lit(0)
    threshold = F.array(of(~flipped, least, zero), of(flipped, zero, n - least + 1))
    low, high = F.when(kind == "cardinality", low).otherwise(1), F.when(kind == "cardinality", high).otherwise(1)
    counted = F.array(of(~flipped, low, n - high), F.when(low > 0, of(flipped, zero, n - low + 1)), F.when(high < n, of(flipped, high + 1, zero)))
    return F.when(least.isNotNull(), threshold).otherwise(F.array_compact(counted))


def gathered(g: exact.Graph) -> DataFrame:
    """The gates with their arguments: gate_id, all (ordinal, arg_id, complement, is_gate, p), connective, min_num, max_num; imply comes with its first argument turned."""
    kinds = g.events.select(F.col("id").alias("arg_id"), F.lit(False).alias("is_gate"), F.col("p").cast("double").alias("p"))
    if not g.flat:
        kinds = kinds.unionByName(g.gates.select(F.col("id").alias("arg_id"), F.lit(True).alias("is_gate"), F.lit(None).cast("double").alias("p")))
    kinds = kinds.groupBy("arg_id").agg(F.max("is_gate").alias("is_gate"), F.max("p").alias("p"))
    args = g.args.join(kinds, "arg_id", "left").withColumn("is_gate", F.coalesce("is_gate", F.lit(False)))
    rows = args.groupBy("gate_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", "arg_id", "complement", "is_gate", "p"))).alias("all")).join(g.gates.withColumnRenamed("id", "gate_id"), "gate_id")
    turned = lambda x: x.withField("complement", x["complement"] != (x["ordinal"] == 0))
    return rows.withColumn("all", F.when(F.col("connective") == "imply", F.transform("all", turned)).otherwise(F.col("all")))


def _literal(x: Column, true: bool | Column, failures_only: bool) -> Column:
    """(kind, gate, lit, p) of an argument that is to be ``true``, or not; its kind is lit, or gone if it takes nothing, or never."""
    negative = x["complement"] == true
    constant = x["arg_id"].isin(exact.TRUE, exact.FALSE)
    holds = (x["arg_id"] == exact.TRUE) != negative
    # true constants go, false ones take the alternative with them
    kind = F.when(constant, F.when(holds, "gone").otherwise("never")).when(~x["is_gate"] & negative & F.lit(failures_only), "gone").otherwise("lit")
    return F.struct(kind.alias("kind"), x["is_gate"].alias("gate"), F.concat(F.when(negative, NOT).otherwise(""), x["arg_id"]).alias("lit"), F.when(negative, 1 - x["p"]).otherwise(x["p"]).alias("p"))


def alternatives(rows: DataFrame, rounds: graphs.Rounds, failures_only: bool) -> DataFrame:
    """(gate, set): for ``gate``, with ``!`` before it if it must be false, its alternatives as sets of (gate, lit, p), from the gates as ``gathered``."""
    rows = rows.select("gate_id", "all", F.explode(_patterns(F.size("all"))).alias("x")).select("gate_id", "all", "x.*")
    rows = ccf.chosen(ccf.chosen(rounds.save(rows), "ons", "ons_args"), "offs", "offs_args")
    rows = rows.where(~F.arrays_overlap(F.transform("ons_args", lambda x: x["ordinal"]), F.transform("offs_args", lambda x: x["ordinal"])) | (F.col("ons") == 0) | (F.col("offs") == 0))
    both = F.concat(F.transform("ons_args", lambda x: _literal(x, F.lit(True), failures_only)), F.transform("offs_args", lambda x: _literal(x, F.lit(False), failures_only)))
    rows = rows.withColumn("all", both).where(~F.exists("all", lambda x: x["kind"] == "never"))
    one = F.transform(F.filter("all", lambda x: x["kind"] == "lit"), lambda x: F.struct(x["gate"].alias("gate"), x["lit"].alias("lit"), x["p"].alias("p")))
    return rows.select(F.concat(F.when(F.col("sign"), "").otherwise(NOT), "gate_id").alias("gate"), one.alias("set"))


def _in_row() -> Column:
    """Whether a gate as ``gathered`` is over different events only, and has few alternatives."""
    n, least = F.size("all"), _least(F.size("all"))
    few = least.between(0, n) & (ccf.binomial(n, F.when(F.col("connective").isin("nand", "nor", "not"), n - least + 1).otherwise(least)) <= IN_ROW)
    names = F.array_distinct(F.transform("all", lambda x: x["arg_id"]))
    return F.coalesce(few & ~F.exists("all", lambda x: x["is_gate"]) & (F.size(names) == n), F.lit(False))


def _choices(items: Column, k: Column) -> Column:
    """All choices of ``k`` of the items of an array, each in their order; none is begun that cannot be ended."""
    n = F.size(items)

    def longer(sets: Column, j: Column) -> Column:
        after = lambda s: F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i > F.coalesce(F.get(s, F.size(s) - 1), F.lit(-1))) & (i < n - k + j))
        return F.flatten(F.transform(sets, lambda s: F.transform(after(s), lambda i: F.concat(s, F.array(i)))))

    some = F.aggregate(F.sequence(F.lit(1), k), F.array(F.array().cast("array<int>")), longer)
    some = F.transform(some, lambda s: F.transform(s, lambda i: F.get(items, i)))
    return F.when(k > n, F.slice(F.array(items), 1, 0)).when(k == n, F.array(items)).when(k == 1, F.transform(items, lambda x: F.array(x))).when(k == 0, F.array(F.slice(items, 1, 0))).otherwise(some)


def cuts_in_rows(rows: DataFrame, limit_order: int, cut_off: float) -> DataFrame:
    """(root, product, p): the minimal cut sets, within the limits, of the gates as ``gathered`` for which ``_in_row`` holds."""
    n, negated = F.size("all"), F.col("connective").isin("nand", "nor", "not")
    lits = F.array_sort(F.transform("all", lambda x: _literal(x, ~negated, True)))
    rows = rows.select(F.col("gate_id").alias("root"), lits.alias("lits"), F.when(negated, n - _least(n) + 1).otherwise(_least(n)).cast("int").alias("k"))
    # most gates are over events that may all occur
    plain = F.forall("lits", lambda x: x["kind"] == "lit")
    kept = F.transform(F.filter(F.col("sets"), lambda s: ~F.exists(s, lambda x: x["kind"] == "never")), lambda s: F.filter(s, lambda x: x["kind"] == "lit"))
    rows = rows.withColumn("sets", _choices(F.col("lits"), F.col("k"))).withColumn("sets", F.when(plain, F.col("sets")).otherwise(F.array_distinct(kept)))
    weight = lambda s: F.aggregate(s, F.lit(1.0), lambda a, x: a * F.coalesce(x["p"], F.lit(1.0)))
    rows = rows.withColumn("sets", F.filter("sets", lambda s: (F.size(s) <= limit_order) & (weight(s) >= cut_off)))
    rows = rows.select("root", F.transform("sets", lambda s: F.struct(F.transform(s, lambda x: x["lit"]).alias("cut"), F.aggregate(s, F.lit(1.0), lambda a, x: a * x["p"]).alias("p"))).alias("sets"))
    sizes = F.array_distinct(F.transform("sets", lambda x: F.size(x["cut"])))
    rows = rows.select("root", F.explode(F.when(F.size(sizes) > 1, quantify.absorbing(F.col("sets"))).otherwise(F.col("sets"))).alias("x"))
    return rows.select("root", F.col("x.cut").alias("product"), F.col("x.p").alias("p"))


def _opposed(lits: Column) -> Column:
    return F.exists(lits, lambda x: F.array_contains(lits, F.concat(F.lit(NOT), x)))


def expand(g: exact.Graph, rows: DataFrame, roots: DataFrame, limit_order: int, cut_off: float, failures_only: bool, rounds: graphs.Rounds) -> DataFrame:
    """(root, product, p, shares): the sets that expanding ``roots`` (id) gives, within the limits, before absorption; ``rows`` are the
    gates as ``gathered``, ``shares`` the literals' own p."""
    _, left = graphs.levels(g.edges)
    if not left.isEmpty():
        raise CycleError("gates refer to themselves")
    step = rounds.save(alternatives(rows, rounds, failures_only))
    none = F.array().cast("array<struct<lit:string,p:double>>")
    state = roots.select(F.col("id").alias("root"), F.array("id").alias("open"), none.alias("cut")).distinct()
    done = None
    while True:
        state = rounds.save(state)
        ended = state.where(F.size("open") == 0).select("root", "cut")
        done = ended if done is None else done.unionByName(ended)
        state = state.where(F.size("open") > 0)
        if state.isEmpty():
            break
        state = state.withColumn("gate", F.get("open", F.lit(0))).join(step, "gate")
        gates = F.transform(F.filter("set", lambda x: x["gate"]), lambda x: x["lit"])
        events = F.transform(F.filter("set", lambda x: ~x["gate"]), lambda x: F.struct(x["lit"].alias("lit"), x["p"].alias("p")))
        state = state.select("root", F.array_sort(F.array_union(F.slice("open", F.lit(2), F.greatest(F.size("open") - 1, F.lit(0))), gates)).alias("open"), F.array_sort(F.array_union("cut", events)).alias("cut"))
        lits = F.transform("cut", lambda x: x["lit"])
        weight = F.aggregate("cut", F.lit(1.0), lambda a, x: a * F.coalesce(x["p"], F.lit(1.0)))
        state = state.where((F.size("cut") <= limit_order) & ~_opposed(lits) & ~_opposed(F.col("open")) & (weight >= cut_off)).distinct()
    return done.distinct().select("root", F.transform("cut", lambda x: x["lit"]).alias("product"), F.aggregate("cut", F.lit(1.0), lambda a, x: a * x["p"]).alias("p"), F.transform("cut", lambda x: x["p"]).alias("shares"))


def absorbed(products: DataFrame, rounds: graphs.Rounds) -> DataFrame:
    """Products without those that contain another one of their root."""
    return rounds.save(quantify.minimal(products.withColumnRenamed("product", "cut")).withColumnRenamed("cut", "product"))


def _consensus(sets: Column, limit_order: int) -> Column:
    """An array of structs with ``cut`` and, of every two that oppose each other in exactly one event, their consensus; absorbed."""

    def of_two(yes: Column, no: Column) -> Column:
        clash = F.filter(yes["cut"], lambda x: F.array_contains(no["cut"], F.concat(F.lit(NOT), x)))
        both = F.array_except(F.array_union(yes["cut"], no["cut"]), F.concat(clash, F.transform(clash, lambda x: F.concat(F.lit(NOT), x))))
        return F.when(F.size(clash) == 1, F.struct(F.array_sort(both).alias("cut")))

    new = F.flatten(F.transform(sets, lambda yes: F.array_compact(F.transform(sets, lambda no: of_two(yes, no)))))
    new = F.filter(new, lambda x: (F.size(x["cut"]) <= limit_order) & ~_opposed(x["cut"]))
    return F.array_sort(F.array_union(sets, new))


def _primes_together(products: DataFrame, limit_order: int, rounds: graphs.Rounds) -> tuple[DataFrame, DataFrame | None]:
    """(root, product, p) from (root, product, shares) of roots with few products, all of a root's in one row; and the (root, product)
    of those that come to more than ``quantify.TOGETHER``, as they were given."""
    entries = F.arrays_zip(F.col("product").alias("lit"), F.col("shares").alias("p"))
    state = products.groupBy("root").agg(F.collect_set(F.struct(F.col("product").alias("cut"))).alias("given"), F.array_distinct(F.flatten(F.collect_list(entries))).alias("shares"))
    state = rounds.save(state.withColumn("given", F.array_sort("given")).withColumn("sets", F.array_sort(quantify.absorbing(F.col("given")))))
    done, over = None, None
    while True:
        more = state.withColumn("more", _consensus(F.col("sets"), limit_order))
        more = more.withColumn("more", F.array_sort(quantify.absorbing(F.col("more"))))
        more = rounds.save(more)
        ended = more.where("more = sets").drop("more")
        done = ended if done is None else done.unionByName(ended)
        state = more.where("more <> sets").drop("sets").withColumnRenamed("more", "sets")
        large = state.where(F.size("sets") > quantify.TOGETHER).select("root", F.explode("given").alias("x")).select("root", F.col("x.cut").alias("product"))
        over = large if over is None else over.unionByName(large)
        state = state.where(F.size("sets") <= quantify.TOGETHER)
        if state.isEmpty():
            break
    out = done.select("root", F.map_from_entries("shares").alias("of"), F.explode("sets").alias("x"))
    p = F.aggregate("x.cut", F.lit(1.0), lambda a, lit: a * F.element_at("of", lit))
    return out.select("root", F.col("x.cut").alias("product"), p.alias("p")), over


def prime(products: DataFrame, events: DataFrame, limit_order: int, rounds: graphs.Rounds) -> DataFrame:
    """The prime implicants of functions given by all their ``products``: consensus of two that oppose each other in one event, until nothing is new."""
    name = lambda x: F.regexp_replace(x, f"^{NOT}", "")
    have = absorbed(products.select("root", "product").distinct(), rounds)
    while True:
        each = have.select("root", "product", F.explode("product").alias("lit")).withColumn("event", name(F.col("lit")))
        one = each.where(~F.col("lit").startswith(NOT)).select("root", "event", F.col("product").alias("yes"))
        two = each.where(F.col("lit").startswith(NOT)).select("root", "event", F.col("product").alias("no"))
        both = F.array_except(F.array_union("yes", "no"), F.array("event", F.concat(F.lit(NOT), "event")))
        new = one.join(two, ["root", "event"]).select("root", F.array_sort(both).alias("product")).where(~_opposed(F.col("product")) & (F.size("product") <= limit_order)).distinct()
        merged = absorbed(have.unionByName(new).distinct(), rounds)
        if merged.join(have, ["root", "product"], "left_anti").isEmpty():
            break
        have = merged
    p = have.select("root", "product", F.explode_outer("product").alias("lit")).withColumn("id", name(F.col("lit"))).join(events, "id", "left")
    share = F.when(F.col("lit").isNull(), 1.0).when(F.col("lit").startswith(NOT), 1 - F.col("p")).otherwise(F.col("p"))
    return p.groupBy("root", "product").agg(F.when(F.count_if(share.isNull()) == 0, F.product(share)).alias("p"))


def primes(products: DataFrame, events: DataFrame, limit_order: int, rounds: graphs.Rounds) -> DataFrame:
    """``prime`` of (root, product, shares): roots with few products each in one row, the others by joins."""
    large = rounds.save(quantify.many(products))
    few = products if graphs.empty(large) else products.join(large, "root", "left_anti")
    done, over = _primes_together(few, limit_order, rounds)
    over = rounds.save(over if graphs.empty(large) else over.unionByName(products.join(large, "root", "left_semi").select("root", "product")))
    return done if graphs.empty(over) else done.unionByName(prime(over, events, limit_order, rounds))


def of_graph(g: exact.Graph, roots: DataFrame, settings: Settings) -> DataFrame:
    """(root, product, p) of the gates ``roots`` (id): minimal cut sets, or prime implicants if the settings ask for them."""
    rounds = graphs.Rounds(g.gates.sparkSession)
    g, failures_only = g.saved(rounds), not settings.prime_implicants
    rows = rounds.save(gathered(g).withColumn("in_row", _in_row() & F.lit(failures_only)), "in_row")
    here, rest = rows.where("in_row").drop("in_row"), rows.where("NOT in_row")
    done = cuts_in_rows(here.join(roots.select(F.col("id").alias("gate_id")).distinct(), "gate_id", "left_semi"), settings.limit_order, settings.cut_off)
    if failures_only and rest.isEmpty():
        return done
    left = roots.select("id").distinct().join(here.select(F.col("gate_id").alias("id")), "id", "left_anti")
    found = rounds.save(expand(g, rows.drop("in_row"), left, settings.limit_order, settings.cut_off, failures_only, rounds))
    return primes(found, g.events, settings.limit_order, rounds) if settings.prime_implicants else done.unionByName(absorbed(found.drop("shares"), rounds))


def cut_sets(model: Model, roots: DataFrame | None = None) -> DataFrame:
    """(root, product, p) of the top gates of a model, or of ``roots`` (id), by the model's settings; house events as declared, common causes applied.

    With an approximation the model's substitutions are applied to the products.
    """
    roots = (roots if roots is not None else model.top_events.select(F.col("gate_id").alias("id"))).select("id").distinct().withColumn("scenario", F.lit(""))
    g, placed = exact.in_states(exact.graph(model, roots=roots), model.house_events, roots)
    found = of_graph(g, placed.select("id"), model.settings)
    return substituted(found, model.substitutions, g.events) if model.settings.approximation in ("rare-event", "mcub") else found


def substituted(products: DataFrame, subs: DataFrame, events: DataFrame) -> DataFrame:
    """Products (root, product, p) with substitutions carried out: where a hypothesis holds for the events of a product, the
    source events go and the target comes; with the target false the product goes. All of them see the products as given."""
    if subs.isEmpty():
        return products
    rounds = graphs.Rounds(products.sparkSession)
    numbered = rounds.save(products.withColumn("at", F.monotonically_increasing_id()))
    subs = rounds.save(subs.where(substitutions.problem().isNull()).select("name", "connective", "min_num", "hypothesis", "source", "target_event", "target_const"))
    met = numbered.select("at", F.explode("product").alias("event")).join(subs.select("name", F.explode("hypothesis").alias("event")), "event").groupBy("at", "name").agg(F.count("*").alias("n"))
    least = F.when(F.col("connective") == "and", F.size("hypothesis")).when(F.col("connective") == "atleast", F.col("min_num")).otherwise(1)
    held = met.join(subs, "name").where(F.col("n") >= least)
    goes = F.flatten(F.collect_list(F.coalesce("source", F.array().cast("array<string>"))))
    change = held.groupBy("at").agg(goes.alias("goes"), F.collect_set("target_event").alias("comes"), F.bool_or(F.coalesce(~F.col("target_const"), F.lit(False))).alias("deleted"))
    rows = numbered.join(change, "at", "left").where(~F.coalesce("deleted", F.lit(False)))
    to = F.when(F.col("goes").isNull(), F.col("product")).otherwise(F.array_sort(F.array_union(F.array_except("product", "goes"), "comes")))
    # probabilities change by what goes and comes: taken anew from the events
    changed = rounds.save(rows.select("at", "root", "p", "goes", to.alias("product")))
    name = F.regexp_replace("lit", f"^{NOT}", "")
    lits = changed.where("goes IS NOT NULL").select("at", F.explode("product").alias("lit")).withColumn("id", name).join(events, "id", "left")
    share = F.when(F.col("lit").startswith(NOT), 1 - F.col("p")).otherwise(F.col("p"))
    anew = lits.groupBy("at").agg(F.when(F.count_if(share.isNull()) == 0, F.product(share)).alias("q"))
    out = changed.join(anew, "at", "left").select("root", "product", F.when(F.col("goes").isNull(), F.col("p")).when(F.size("product") == 0, 1.0).otherwise(F.col("q")).alias("p")).dropDuplicates(["root", "product"])
    return absorbed(out, rounds)


def approximated(products: DataFrame, approximation: str) -> DataFrame:
    """(root, p) from the products' probabilities by ``rare-event`` or ``mcub``."""
    certain = F.max(F.col("p") >= 1)
    p = quantify.rare_event(F.col("p")) if approximation == "rare-event" else F.when(certain, 1.0).otherwise(quantify.mcub(F.when(F.col("p") < 1, F.col("p")).otherwise(0.0)))
    return products.groupBy("root").agg(p.alias("p"))


def probabilities(model: Model, roots: DataFrame | None = None) -> DataFrame:
    """(id, p) of the top gates, or of ``roots``, as the settings ask: exact, from cut sets, or by trials."""
    from . import evaluate

    how = model.settings.approximation
    if how == "none":
        return exact.model_probabilities(model, roots)
    tops = (roots if roots is not None else model.top_events.select(F.col("gate_id").alias("id"))).select("id").distinct()
    if how == "monte-carlo":
        return evaluate.simulate(model).join(tops, "id", "left_semi").select("id", "p")
    found = approximated(cut_sets(model, tops), how)
    return tops.join(found.withColumnRenamed("root", "id"), "id", "left").fillna(0.0, ["p"])
