"""Substitutions and alignments: kinds, validity, conflicts, phase fractions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def declarative(source: Column) -> Column:
    return F.coalesce(F.size(source), F.lit(0)) == 0


def kind() -> Column:
    """delete-terms, recovery-rule, exchange-event or null, from connective, min_num, hypothesis, source, target_event, target_const."""
    hypothesis, source, connective = F.col("hypothesis"), F.col("source"), F.col("connective")
    no_source, event = declarative(source), F.col("target_event").isNotNull()
    exclusive = ((connective == "atleast") & (F.col("min_num") == 2)) | ((connective == "and") & (F.size(hypothesis) == 2))
    inside = F.size(F.array_except(source, hypothesis)) == 0
    as_many = F.size(source) == F.size(hypothesis)
    replaced = ~no_source & event & connective.isin("and", "null") & inside
    return (
        F.when(no_source & F.col("target_const").isNotNull() & exclusive, "delete-terms")
        .when(no_source & event & (connective == "and"), "recovery-rule")
        .when(replaced & as_many, "recovery-rule")
        .when(replaced & (F.size(source) == 1), "exchange-event")
    )


def problem() -> Column:
    """Why a substitution is not valid; null if it is. ``other_kinds`` and ``complemented`` tell whether its hypothesis has
    arguments that are no basic events, or complements."""
    connective, no_source = F.col("connective"), declarative(F.col("source"))
    to = F.col("target_const")
    return (
        F.when(F.col("other_kinds"), "hypothesis over other than basic events")
        .when(F.col("complemented"), "hypothesis with complements")
        .when(no_source & ~connective.isin("null", "and", "atleast", "or"), "connective of a declarative hypothesis")
        .when(no_source & F.coalesce(to, F.lit(False)), "declarative with target true")
        .when(~no_source & ~connective.isin("null", "and", "or"), "connective of a non-declarative hypothesis")
        .when(~no_source & F.coalesce(~to, F.lit(False)), "non-declarative with target false")
    )


def conflicts(subs: DataFrame) -> DataFrame:
    """(name, event, why) of non-declarative substitutions whose target is anyone's source, or whose target or source is
    in another one's hypothesis. Events meet in equi-joins; no pairs of substitutions are made."""
    active = subs.where(~declarative(F.col("source")))
    source = active.select("name", F.explode("source").alias("event"))
    target = active.where("target_event IS NOT NULL").select("name", F.col("target_event").alias("event"))
    hypothesis = active.select(F.col("name").alias("other"), F.explode("hypothesis").alias("event"))
    # of the hypotheses with an event, two different names tell whether another one has it
    holders = hypothesis.groupBy("event").agg(F.min("other").alias("lo"), F.max("other").alias("hi"))
    # many substitutions may have one target: what is known of it is looked up once, and meets them from a small table
    aims = target.select("event").distinct()
    in_source = target.join(aims.join(source.select("event").distinct(), "event", "left_semi"), "event").select("name", "event", F.lit("target is a source").alias("why"))
    other = (F.col("lo") != F.col("name")) | (F.col("hi") != F.col("name"))
    by_target = target.join(holders.join(aims, "event", "left_semi"), "event").where(other).select("name", "event", F.lit("target in another hypothesis").alias("why"))
    by_source = source.join(holders, "event").where(other).select("name", "event", F.lit("source in another hypothesis").alias("why"))
    return in_source.unionByName(by_target).unionByName(by_source).distinct()


def phase_problems(phases: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """(alignment, total, problem) of fractions outside (0, 1] or sums that are not 1."""
    sums = phases.groupBy("alignment").agg(F.sum("fraction").alias("total"), F.count_if(~((F.col("fraction") > 0) & (F.col("fraction") <= 1))).alias("bad"))
    problem_ = F.when(F.col("bad") > 0, "fraction outside (0, 1]").when(F.abs(F.col("total") - 1) > tolerance, "fractions do not sum to 1")
    return sums.select("alignment", "total", problem_.alias("problem"))
