"""References: the local path first, then a public name, then an absolute path; among kinds, gate before basic before house event."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .elements import full_path

#: Containers that are broadcast, at most.
MANY = 20_000
KINDS = ("gate", "basic-event", "house-event")


def resolve(references: DataFrame, entities: DataFrame) -> DataFrame:
    """References (base_path, ref) with ``id`` and ``kind`` of the entity (id, role, full_path, kind) that they mean, or nulls.

    Only the immediate base path is tried. Each of the two lookups is one equi-join, by keys that are never null; the entity
    table has one row a key, so no reference is multiplied.
    """
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    rank = F.when(rank > 0, rank).otherwise(len(KINDS) + 1)
    best = F.min_by(F.struct("id", "kind"), rank)
    by_path = entities.where("full_path IS NOT NULL").groupBy(F.col("full_path").alias("_key")).agg(best.alias("_hit"))
    # a name without a point means a public element; any other an absolute path: paths have points, so one table holds both
    by_name = entities.where((F.col("role") == "public") & F.col("id").isNotNull() & ~F.contains("id", F.lit("."))).groupBy(F.col("id").alias("_key")).agg(best.alias("_hit"))
    keep = references.columns
    refs = references.withColumn("_base", F.coalesce("base_path", F.lit("")))
    # only references in containers that have entities at all can be local
    at = entities.where("full_path IS NOT NULL AND base_path <> ''").select("base_path") if "base_path" in entities.columns else references.select("base_path").where("base_path <> ''")
    bases = at.select(F.col("base_path").alias("_base")).distinct()
    if bases.limit(MANY + 1).count() <= MANY:
        bases = F.broadcast(bases)
    refs = refs.join(bases.withColumn("_holds", F.lit(True)), "_base", "left")
    local = refs.where("_holds").withColumn("_try", full_path(F.col("base_path"), F.col("ref")))
    local = local.join(by_path.select(F.col("_key").alias("_try"), F.col("_hit").alias("_local")), "_try", "left").select(*keep, "_local")
    other = refs.where("_holds IS NULL").select(*keep, F.lit(None).cast(dict(local.dtypes)["_local"]).alias("_local"))
    refs = local.unionByName(other)
    refs = refs.join(by_path.unionByName(by_name), F.col("ref") == F.col("_key"), "left")
    hit = F.coalesce("_local", "_hit")
    return refs.select(*keep, hit["id"].alias("id"), hit["kind"].alias("kind"))


def unit_mismatch(references: DataFrame, parameters: DataFrame) -> DataFrame:
    """References (ref, unit) whose unit is given and differs from the parameter's (id, unit)."""
    known = parameters.select(F.col("id").alias("_id"), F.col("unit").alias("defined_unit"))
    return references.join(known, F.col("ref") == F.col("_id")).where("unit IS NOT NULL AND unit <> '' AND unit <> coalesce(defined_unit, 'unitless')").drop("_id")
