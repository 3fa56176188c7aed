"""Interval domains: closed ranges [lo, hi] of what an expression can take, propagated through operators.

Unary operators map the end points (also where they are not monotone, as the model format's tools do; ``exact_abs``
gives the true range of abs), binary ones the four corners, n-ary ones fold.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import numeric


@dataclass(frozen=True)
class Interval:
    lo: Column
    hi: Column

    @staticmethod
    def of(lo: float | Column, hi: float | Column) -> Interval:
        as_column = lambda x: x if isinstance(x, Column) else F.lit(float(x))
        return Interval(as_column(lo), as_column(hi))

    def contains(self, x: Column) -> Column:
        return (self.lo <= x) & (x <= self.hi)

    def within(self, lo: float, hi: float) -> Column:
        return (self.lo >= lo) & (self.hi <= hi)

    def is_probability(self) -> Column:
        return self.within(0.0, 1.0)

    def is_non_negative(self) -> Column:
        return self.lo >= 0

    def is_positive(self) -> Column:
        return self.lo > 0


#: Ranges that do not depend on the argument's.
RANGES = {"acos": (0.0, math.pi), "asin": (-math.pi / 2, math.pi / 2), "atan": (-math.pi / 2, math.pi / 2), "cos": (-1.0, 1.0), "sin": (-1.0, 1.0)}


def _ends(values: list[Column]) -> Interval:
    return Interval(F.least(*values), F.greatest(*values))


def propagate(op: str, *args: Interval, exact_abs: bool = False) -> Interval:
    """The domain of an operator over its arguments' domains."""
    if op in RANGES:
        return Interval.of(*RANGES[op])
    if op == "mean":
        n = F.lit(float(len(args)))
        return Interval(reduce(lambda a, b: a + b, [x.lo for x in args]) / n, reduce(lambda a, b: a + b, [x.hi for x in args]) / n)
    if op == "ite":
        return _ends([args[1].lo, args[1].hi, args[2].lo, args[2].hi])
    if op == "switch":
        values = [*args[1:-1:2], args[-1]]
        ends = [e for v in values for e in (v.lo, v.hi)]
        return _ends(ends)
    if len(args) == 1:
        a = args[0]
        out = _ends([numeric.apply(op, a.lo), numeric.apply(op, a.hi)])
        if op == "abs" and exact_abs:
            return Interval(F.when(a.contains(F.lit(0.0)), 0.0).otherwise(out.lo), out.hi)
        return out
    corners = lambda a, b: _ends([numeric.apply(op, x, y) for x in (a.lo, a.hi) for y in (b.lo, b.hi)])
    return reduce(corners, args)


def domain_problem(op: str, *args: Interval) -> Column | None:
    """True where a domain reaches values that the operator is not defined for."""
    zero = F.lit(0.0)
    if op == "div":
        return reduce(lambda a, b: a | b, [x.contains(zero) for x in args[1:]])
    if op == "mod":
        return (args[1].lo.cast("int") <= 0) & (args[1].hi.cast("int") >= 0)
    if op in ("acos", "asin"):
        return ~args[0].within(-1.0, 1.0)
    if op in ("log", "log10"):
        return ~args[0].is_positive()
    if op == "sqrt":
        return ~args[0].is_non_negative()
    if op == "pow":
        return args[0].contains(zero) & ~args[1].is_positive()
    return None
