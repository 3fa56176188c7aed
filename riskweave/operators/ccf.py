"""Common-cause failures: factor levels, the four models, and the expansion into events of member combinations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MODELS = ("beta-factor", "MGL", "alpha-factor", "phi-factor")


def binomial(n: Column, k: Column) -> Column:
    """C(n, k) by products, as a double."""
    return F.aggregate(F.when(k > 0, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>")), F.lit(1.0), lambda a, i: a * (n - k + i) / i)


def factor_levels(factors: DataFrame) -> DataFrame:
    """(group_id, ordinal, level, factor) with levels filled in: one after the previous, from the least level at first.

    ``min_level`` comes with each row; a level that is given starts the count anew.
    """
    w = Window.partitionBy("group_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    given = F.last(F.when(F.col("level").isNotNull(), F.struct("level", "ordinal")), ignorenulls=True).over(w)
    place = F.row_number().over(Window.partitionBy("group_id").orderBy("ordinal"))
    rows = factors.withColumn("_p", place)
    given = F.last(F.when(F.col("level").isNotNull(), F.struct("level", "_p")), ignorenulls=True).over(w)
    level = F.coalesce(given["level"] + F.col("_p") - given["_p"], F.col("min_level") + F.col("_p") - 1)
    return rows.withColumn("level", level.cast("int")).drop("_p")


def level_problems(levels: DataFrame) -> DataFrame:
    """(group_id, problem) for levels outside [min_level, n], given twice, or missing; rows carry n and min_level."""
    outside = levels.where("level < min_level OR level > n").select("group_id", F.lit("level out of range").alias("problem"))
    twice = levels.groupBy("group_id", "level").count().where("count > 1").select("group_id", F.lit("level given twice").alias("problem"))
    gap = levels.groupBy("group_id").agg(F.max("level").alias("hi"), F.first("min_level").alias("lo"), F.countDistinct("level").alias("k")).where("k <> hi - lo + 1")
    return outside.unionByName(twice).unionByName(gap.select("group_id", F.lit("missing level").alias("problem"))).distinct()


def level_probabilities(levels: DataFrame) -> DataFrame:
    """(group_id, level, q): the probability of one event of each level, from (group_id, model, n, q_total, level, factor)."""
    w = Window.partitionBy("group_id").orderBy("level")
    group = Window.partitionBy("group_id")
    share = 1 / binomial(F.col("n") - 1, F.col("level") - 1)
    # beta: what is not common stays with the single events
    beta = levels.where("model = 'beta-factor'")
    beta = beta.select("group_id", "level", (F.col("factor") * F.col("q_total")).alias("q")).unionByName(
        beta.select("group_id", F.lit(1).alias("level"), ((1 - F.col("factor")) * F.col("q_total")).alias("q"))
    )
    # MGL: factors from level 2; the single level has the factor 1
    mgl = levels.where("model = 'MGL'").select("group_id", "n", "q_total", "level", "factor")
    ones = mgl.select("group_id", "n", "q_total").distinct().withColumns({"level": F.lit(1), "factor": F.lit(1.0)})
    mgl = mgl.unionByName(ones)
    product = F.product("factor").over(w.rowsBetween(Window.unboundedPreceding, 0))
    mgl = mgl.select("group_id", "level", (share * product * (1 - F.coalesce(F.lead("factor").over(w), F.lit(0.0))) * F.col("q_total")).alias("q"))
    alpha = levels.where("model = 'alpha-factor'")
    alpha = alpha.select("group_id", "level", (F.col("level") * share * F.col("factor") / F.sum(F.col("level") * F.col("factor")).over(group) * F.col("q_total")).alias("q"))
    phi = levels.where("model = 'phi-factor'").select("group_id", "level", (F.col("factor") * F.col("q_total")).alias("q"))
    return beta.unionByName(mgl).unionByName(alpha).unionByName(phi)


def combinations(members: DataFrame, levels: DataFrame | None = None) -> DataFrame:
    """(group_id, level, members) for every combination of a group's members, in their order.

    ``levels`` (group_id, level): the sizes to make; all from 1 to the number of members, if not given. Combinations of
    a size grow index by index, each from the ones before it; of more than half the members, what they leave out does.
    """
    groups = members.groupBy("group_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "event_id"))), lambda x: x["event_id"]).alias("all"))
    n = F.size("all")
    rows = groups.join(levels, "group_id") if levels is not None else groups.withColumn("level", F.explode(F.sequence(F.lit(1), n)))
    return chosen(rows, "level", "members").select("group_id", "level", "members")


def chosen(rows: DataFrame, level: str, into: str) -> DataFrame:
    """Rows with an array ``all``, once for each choice of ``level`` (a column) of its elements, which go to ``into``."""
    n, columns = F.size("all"), [c for c in rows.columns if c not in ("all", level)]
    rows = rows.withColumn(level, F.col(level).cast("int")).withColumn("size", F.least(F.col(level), n - F.col(level))).where("size >= 0")
    rows = rows.withColumn("at", F.array().cast("array<int>"))
    for step in range(rows.agg(F.max("size")).first()[0] or 0):
        after = F.when(F.size("at") > 0, F.element_at("at", -1) + 1).otherwise(F.lit(0)) if step else F.lit(0)
        more = F.sequence(after, n - F.col("size") + step)
        longer = F.when(F.col("size") > step, F.transform(more, lambda i: F.concat("at", F.array(i)))).otherwise(F.array("at"))
        rows = rows.select(*columns, "all", level, "size", F.explode(longer).alias("at"))
    # of a large group, members are taken by their indices, not by going through all
    left_out = F.filter("all", lambda _, i: ~F.array_contains("at", i))
    taken = F.when(F.col("size") == F.col(level), F.transform("at", lambda i: F.get("all", i))).otherwise(left_out)
    return rows.select(*columns, "all", level, taken.alias(into))


def event_name(members: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(members, " "), F.lit("]"))


def expand(members: DataFrame, probabilities: DataFrame) -> DataFrame:
    """(group_id, level, event_id, members, q): the events of all levels that the model has."""
    found = combinations(members, probabilities.select("group_id", "level").distinct()).join(probabilities, ["group_id", "level"])
    return found.select("group_id", "level", event_name(F.col("members")).alias("event_id"), "members", "q")


def proxy_args(events: DataFrame) -> DataFrame:
    """(gate_id, arg_id): each member becomes an OR over the events that it is in."""
    return events.select(F.explode("members").alias("gate_id"), F.col("event_id").alias("arg_id"))
