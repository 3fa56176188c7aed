"""Analyses of loaded models by their settings: uncertainty of top gates, and their safety integrity over the mission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import graphs
from . import evaluate, exact, quantify
from .model import Model


def _tops(model: Model, roots: DataFrame | None) -> DataFrame:
    return (roots if roots is not None else model.top_events.select(F.col("gate_id").alias("id"))).select("id").distinct()


def _at_points(model: Model, roots: DataFrame | None, **how) -> DataFrame:
    """(id, point, p) of top gates, exact, for every trial or time."""
    rounds = graphs.Rounds(model.nodes.sparkSession)
    tops = rounds.save(_tops(model, roots))
    combined = evaluate.needed_events(model, tops)
    points = rounds.save(evaluate._base(model, combined, **how).withColumnRenamed("trial", "point"))
    g = exact.graph(model, points.select("id").distinct().withColumn("p", F.lit(None).cast("double")), tops, combined)
    g, placed = exact.in_states(g, model.house_events, tops.withColumn("scenario", F.lit("")))
    return exact.at_points(g, points, placed.select("id"))


def trial_probabilities(model: Model, roots: DataFrame | None = None) -> DataFrame:
    """(id, trial, p): exact probabilities of top gates for every draw of the deviates; ``num_trials`` and ``seed`` are the settings'."""
    return _at_points(model, roots, trials=model.settings.num_trials, seed=model.settings.seed).withColumnRenamed("point", "trial")


def uncertainty(sampled: DataFrame, num_quantiles: int, num_bins: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of (id, trial, p): (id, trials, mean, sigma, error_factor), (id, quantile, p) and the histogram (id, bin, lower, upper, trials).

    The error factor is that of a lognormal law: 95 % quantile over median. Bins are of equal width between least and most; all
    trials with one value are one bin.
    """
    mid, high = (F.percentile("p", F.lit(x)) for x in (0.5, 0.95))
    moments = sampled.groupBy("id").agg(F.count("p").alias("trials"), F.mean("p").alias("mean"), F.coalesce(F.stddev("p"), F.lit(0.0)).alias("sigma"), F.try_divide(high, mid).alias("error_factor"))
    shares = [i / num_quantiles for i in range(1, num_quantiles + 1)]
    at = sampled.groupBy("id").agg(F.percentile("p", F.array(*map(F.lit, shares))).alias("q"))
    quantiles = at.select("id", F.posexplode("q").alias("i", "p")).select("id", ((F.col("i") + 1) / num_quantiles).alias("quantile"), "p")
    ends = sampled.groupBy("id").agg(F.min("p").alias("lo"), F.max("p").alias("hi")).withColumn("width", (F.col("hi") - F.col("lo")) / num_bins)
    number = F.when(F.col("width") > 0, F.least(F.floor((F.col("p") - F.col("lo")) / F.col("width")), F.lit(num_bins - 1))).otherwise(0).cast("int")
    bins = sampled.where("p IS NOT NULL").join(ends, "id").withColumn("bin", number).groupBy("id", "bin", "lo", "width").agg(F.count("*").alias("trials"))
    lower = F.col("lo") + F.col("bin") * F.col("width")
    return moments, quantiles, bins.select("id", (F.col("bin") + 1).alias("bin"), lower.alias("lower"), (lower + F.col("width")).alias("upper"), "trials")


def model_uncertainty(model: Model, roots: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``uncertainty`` of the top gates of a model, by its settings."""
    sampled = graphs.Rounds(model.nodes.sparkSession).save(trial_probabilities(model, roots))
    return uncertainty(sampled, model.settings.num_quantiles, model.settings.num_bins)


def over_time(model: Model, roots: DataFrame | None = None) -> DataFrame:
    """(id, time, p): exact probabilities of top gates at the mission times that ``mission_time`` and ``time_step`` of the settings give."""
    mission, step = model.settings.mission_time, model.settings.time_step
    n = int(mission / step) if step else 1
    times = [i * step for i in range(n + 1)] if step else [0.0, mission]
    times += [mission] if times[-1] < mission else []
    at = F.get(F.array(*map(F.lit, times)), F.col("point"))
    return _at_points(model, roots, times=times).select("id", at.alias("time"), "p")


def _inside(p: Column, q: Column, low: float, high: float) -> Column:
    """The share of a straight line from ``p`` to ``q`` that lies between ``low`` and ``high``."""
    bottom, top = F.least(p, q), F.greatest(p, q)
    part = F.greatest(F.least(top, F.lit(high)) - F.greatest(bottom, F.lit(low)), F.lit(0.0)) / F.nullif(top - bottom, F.lit(0.0))
    return F.coalesce(part, ((p >= low) & (p < high)).cast("double"))


def integrity(timed: DataFrame) -> DataFrame:
    """(id, average, level, shares) of (id, time, p): the mean over the mission by trapezoids, its integrity level, and the
    share of the mission in each level's range, from 0 to 4, p taken as straight between the times."""
    order = Window.partitionBy("id").orderBy("time")
    steps = timed.select("id", "time", "p", F.lead("time").over(order).alias("until"), F.lead("p").over(order).alias("q")).where("until IS NOT NULL")
    length = F.col("until") - F.col("time")
    bounds = [0.0, *[b for _, b in quantify.SIL], float("inf")]
    names = [*[level for level, _ in quantify.SIL], 0]
    shares = [(F.sum(_inside(F.col("p"), F.col("q"), bounds[i], bounds[i + 1]) * length) / F.sum(length)).alias(f"s{level}") for i, level in enumerate(names)]
    found = steps.groupBy("id").agg((F.sum((F.col("p") + F.col("q")) / 2 * length) / F.sum(length)).alias("average"), *shares)
    return found.select("id", "average", quantify.integrity_level(F.col("average")).alias("level"), F.array(*[F.col(f"s{level}") for level in sorted(names)]).alias("shares"))


def model_integrity(model: Model, roots: DataFrame | None = None) -> DataFrame:
    """``integrity`` of the top gates of a model, by its settings."""
    return integrity(graphs.Rounds(model.nodes.sparkSession).save(over_time(model, roots)))
