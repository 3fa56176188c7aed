"""Numeric, Boolean and conditional operators as columns of doubles (booleans are 0.0 and 1.0)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def truth(c: Column) -> Column:
    """Any number but zero is true."""
    return c != 0


def number(c: Column) -> Column:
    return c.cast("double")


def _fold(f: Callable[[Column, Column], Column]) -> Callable[..., Column]:
    return lambda *args: reduce(f, args)


def _skip_nan(f: Callable[..., Column]) -> Callable[[Column, Column], Column]:
    return lambda a, b: f(F.nanvl(a, b), F.nanvl(b, a))


def _power(a: Column, b: Column) -> Column:
    return F.pow(a, b)


def _switch(*args: Column) -> Column:
    """Condition and value by turns, then the default."""
    *cases, default = args
    out = None
    for condition, value in zip(cases[::2], cases[1::2], strict=True):
        out = F.when(truth(condition), value) if out is None else out.when(truth(condition), value)
    return default if out is None else out.otherwise(default)


def _compare(f: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    # NaN compares as in IEEE arithmetic, not as Spark sorts it
    return lambda a, b: number(F.when(F.isnan(a) | F.isnan(b), F.lit(False)).otherwise(f(a, b)))


#: XML name -> (least arguments, most arguments or None, column)
OPERATORS: dict[str, tuple[int, int | None, Callable[..., Column]]] = {
    "neg": (1, 1, lambda a: -a),
    "add": (2, None, _fold(lambda a, b: a + b)),
    "sub": (2, None, _fold(lambda a, b: a - b)),
    "mul": (2, None, _fold(lambda a, b: a * b)),
    "div": (2, None, _fold(lambda a, b: F.try_divide(a, b))),
    "abs": (1, 1, F.abs),
    "acos": (1, 1, F.acos),
    "asin": (1, 1, F.asin),
    "atan": (1, 1, F.atan),
    "cos": (1, 1, F.cos),
    "sin": (1, 1, F.sin),
    "tan": (1, 1, F.tan),
    "cosh": (1, 1, F.cosh),
    "sinh": (1, 1, F.sinh),
    "tanh": (1, 1, F.tanh),
    "exp": (1, 1, F.exp),
    "log": (1, 1, F.ln),
    "log10": (1, 1, F.log10),
    "mod": (2, 2, lambda a, b: number(F.try_mod(a.cast("int"), b.cast("int")))),
    "pow": (2, 2, _power),
    "sqrt": (1, 1, F.sqrt),
    "ceil": (1, 1, lambda a: number(F.ceil(a))),
    "floor": (1, 1, lambda a: number(F.floor(a))),
    "min": (2, None, _fold(_skip_nan(F.least))),
    "max": (2, None, _fold(_skip_nan(F.greatest))),
    "mean": (2, None, lambda *args: reduce(lambda a, b: a + b, args) / F.lit(float(len(args)))),
    "not": (1, 1, lambda a: number(~truth(a))),
    "and": (2, None, _fold(lambda a, b: number(truth(a) & truth(b)))),
    "or": (2, None, _fold(lambda a, b: number(truth(a) | truth(b)))),
    "eq": (2, 2, _compare(lambda a, b: a == b)),
    "df": (2, 2, lambda a, b: number(F.when(F.isnan(a) | F.isnan(b), F.lit(True)).otherwise(a != b))),
    "lt": (2, 2, _compare(lambda a, b: a < b)),
    "gt": (2, 2, _compare(lambda a, b: a > b)),
    "leq": (2, 2, _compare(lambda a, b: a <= b)),
    "geq": (2, 2, _compare(lambda a, b: a >= b)),
    "ite": (3, 3, lambda c, a, b: F.when(truth(c), a).otherwise(b)),
    "switch": (1, None, _switch),
}


def apply(op: str, *args: Column) -> Column:
    """The column of an operator; the number of arguments is checked."""
    least, most, f = OPERATORS[op]
    if len(args) < least or (most is not None and len(args) > most):
        raise ValueError(f"{op} takes {least} to {most or 'any number of'} arguments, not {len(args)}")
    return f(*args)


def outside_domain(op: str, *args: Column) -> Column | None:
    """True where an operator is not defined for its arguments' values; None for operators defined everywhere."""
    if op == "div":
        return reduce(lambda a, b: a | b, [x == 0 for x in args[1:]])
    if op in ("acos", "asin"):
        return (args[0] < -1) | (args[0] > 1)
    if op in ("log", "log10"):
        return args[0] <= 0
    if op == "sqrt":
        return args[0] < 0
    if op == "mod":
        return args[1].cast("int") == 0
    if op == "pow":
        return (args[0] == 0) & (args[1] <= 0)
    return None
