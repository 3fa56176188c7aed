"""External functions: Python callables under declared signatures, in place of functions of native libraries."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DLError, DuplicateElementError, IllegalOperation, ValidityError

#: Fixed values of the model format.
TYPES = ("int", "double")
MAX_PARAMETERS = 5


@dataclass(frozen=True)
class Signature:
    returns: str
    parameters: tuple[str, ...]

    def __post_init__(self):
        unknown = [t for t in (self.returns, *self.parameters) if t not in TYPES]
        if unknown:
            raise ValidityError(f"types of external functions are int and double, not {', '.join(unknown)}")
        if len(self.parameters) > MAX_PARAMETERS:
            raise ValidityError(f"external functions take at most {MAX_PARAMETERS} parameters, not {len(self.parameters)}")


class Registry:
    """External functions by name. Off unless allowed: a callable can do anything that the process can."""

    def __init__(self, allow: bool = False):
        self.allow, self.known = allow, {}

    def add(self, name: str, function: Callable, returns: str, *parameters: str) -> None:
        """A function of single values; one with an attribute ``whole_arrays`` that is true takes and gives arrays."""
        if not self.allow:
            raise IllegalOperation("external functions are not allowed")
        if name in self.known:
            raise DuplicateElementError(f"external function {name} is there already")
        if not callable(function):
            raise DLError(f"{name} is not a function")
        self.known[name] = function, Signature(returns, parameters)

    def call(self, name: str, *args: Column) -> Column:
        """A call as a column of doubles; int parameters take the truncated argument, int results are whole numbers."""
        if name not in self.known:
            raise DLError(f"no external function {name}")
        function, signature = self.known[name]
        if len(args) != len(signature.parameters):
            raise ValidityError(f"{name} takes {len(signature.parameters)} arguments, not {len(args)}")
        kinds, whole = signature.parameters, signature.returns == "int"

        @F.pandas_udf(T.DoubleType())
        def run(*columns):
            import pandas as pd

            if getattr(function, "whole_arrays", False):
                arrays = [c.to_numpy(float, na_value=np.nan) for c in columns]
                good = ~np.isnan(arrays).any(axis=0)
                values = np.full(len(good), np.nan)
                if good.any():
                    got = np.asarray(function(*[np.trunc(x[good]).astype(np.int64) if k == "int" else x[good] for x, k in zip(arrays, kinds, strict=True)]), float)
                    values[good] = np.trunc(got) if whole else got
                return pd.Series(values)
            out = []
            for row in zip(*columns, strict=True):
                if any(x is None or math.isnan(x) for x in row):
                    out.append(None)
                    continue
                value = function(*[int(x) if k == "int" else float(x) for x, k in zip(row, kinds, strict=True)])
                out.append(float(int(value)) if whole else float(value))
            return pd.Series(out, dtype=float)

        if not args:  # no arguments, one value
            value = function()
            return F.lit(float(int(value)) if whole else float(value))
        return run(*[a.cast("double") for a in args])
