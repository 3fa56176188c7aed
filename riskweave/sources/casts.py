"""Strict casts of texts: the whole token or nothing (null)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trim(text: Column) -> Column:
    """Without spaces at the ends; other white space stays."""
    return F.trim(text, F.lit(" "))


def to_int(text: Column) -> Column:
    """A 32-bit integer."""
    return F.when(text.rlike(r"\A[+-]?[0-9]+\z"), text.try_cast("int"))


def to_double(text: Column) -> Column:
    """A finite double."""
    value = F.when(text.rlike(r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"), text.try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def to_bool(text: Column) -> Column:
    """``true``, ``1``, ``false``, ``0`` and nothing else."""
    return F.when(text.isin("true", "1"), True).when(text.isin("false", "0"), False)
