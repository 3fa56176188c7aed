"""Streams: model files that arrive over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import elements
from ..sources import xml_nodes


def name_violations(spark: SparkSession, folder: str) -> DataFrame:
    """Violations that one file's nodes show by themselves, as files arrive: malformed files and bad names.

    Nothing is kept between files, so the stream needs no state and no watermark.
    """
    nodes = xml_nodes.stream_nodes(spark, folder)
    broken = elements.violation(nodes.where("tag = '#error'"), "1 parse", "XmlError", F.col("file"), F.col("text"), F.col("file"))
    named = nodes.where(F.col("tag").startswith("define-"))
    bad = named.where(elements.bad_name(F.trim(F.coalesce(F.col("attrs")["name"], F.lit("")), F.lit(" "))))
    return broken.unionByName(elements.violation(bad, "2 define", "ValidityError", F.col("tag"), "name is empty or holds a point", F.col("file"), F.col("line")))
