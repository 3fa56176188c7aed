"""Element tables: uniqueness, lookup, names, roles, attributes, usage. Problems are rows of a violations table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VIOLATION = "stage string, code string, entity string, detail string, file string, line int"
DEFAULT_MODEL_NAME = "__unnamed-model__"


def violation(df: DataFrame, stage: str, code: str, entity: Column, detail: Column | str, file: Column | None = None, line: Column | None = None) -> DataFrame:
    """Rows of ``df`` as violations."""
    detail = F.lit(detail) if isinstance(detail, str) else detail
    return df.select(
        F.lit(stage).alias("stage"), F.lit(code).alias("code"), entity.cast("string").alias("entity"), detail.alias("detail"),
        (file if file is not None else F.lit(None)).cast("string").alias("file"), (line if line is not None else F.lit(None)).cast("int").alias("line"),
    )


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def duplicates(df: DataFrame, *key: str) -> DataFrame:
    """(key, n) of keys that occur more than once; counted with partial sums."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def undefined(references: DataFrame, table: DataFrame, ref: str, key: str) -> DataFrame:
    """References without a definition."""
    return references.join(table.select(F.col(key).alias(ref)), ref, "left_anti")


def lookup(references: DataFrame, table: DataFrame, ref: str, key: str) -> DataFrame:
    """References with their definition's columns and ``found``."""
    keyed = table.withColumn("found", F.lit(True)).withColumnRenamed(key, "_key")
    return references.join(keyed, F.col(ref) == F.col("_key"), "left").drop("_key").fillna(False, ["found"])


def remove(table: DataFrame, gone: DataFrame, *columns: str) -> DataFrame:
    """The table without the rows that agree with ``gone`` in all the columns."""
    return table.join(gone.select(*columns), list(columns), "left_anti")


def used(elements: DataFrame, references: DataFrame, key: str, ref: str) -> DataFrame:
    return elements.join(references.select(F.col(ref).alias(key)), key, "left_semi")


def unused(elements: DataFrame, references: DataFrame, key: str, ref: str) -> DataFrame:
    return elements.join(references.select(F.col(ref).alias(key)), key, "left_anti")


def full_path(base_path: Column, name: Column) -> Column:
    """base_path.name; with an empty base the point still leads."""
    return F.concat(F.coalesce(base_path, F.lit("")), F.lit("."), name)


def element_id(role: Column, base_path: Column, name: Column) -> Column:
    """Public elements go by name, private ones by full path."""
    return F.when(role == "public", name).otherwise(full_path(base_path, name))


def inherited_role(own: Column, parent: Column) -> Column:
    return F.coalesce(F.when(own != "", own), parent, F.lit("public"))


def bad_name(name: Column) -> Column:
    return F.coalesce(name, F.lit("")).eqNullSafe("") | F.contains(name, F.lit("."))


def bad_role(role: Column, base_path: Column) -> Column:
    """Base paths neither begin nor end with a point; private elements need one."""
    base = F.coalesce(base_path, F.lit(""))
    return base.startswith(".") | base.endswith(".") | ((role == "private") & (base == ""))


def inherit_attributes(parent: Column, own: Column) -> Column:
    """A map with the parent's entries, the element's own ones overriding them."""
    mine = F.coalesce(own, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(F.coalesce(parent, F.create_map().cast("map<string,string>")), lambda k, _: ~F.map_contains_key(mine, k)), mine)


def without_attribute(attributes: Column, name: str) -> Column:
    return F.map_filter(attributes, lambda k, _: k != name)


def optional_name(name: Column) -> Column:
    """Null for a model without a name of its own."""
    return F.nullif(name, F.lit(DEFAULT_MODEL_NAME))


def same_set(a: Column, b: Column) -> Column:
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def intersects(a: Column, b: Column) -> Column:
    """Whether two sets share a member; a missing one shares none."""
    return F.coalesce(F.arrays_overlap(F.array_compact(a), F.array_compact(b)), F.lit(False))


def close(a: Column, b: Column | float, tolerance: float) -> Column:
    """Relative to the left side."""
    return F.abs(a - b) <= F.abs(a) * tolerance
