"""Random deviates drawn by key: the same (seed, trial, node) gives the same draw on any executor and in any order."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def keyed_uniform(seed: int | Column, *key: Column, stream: str = "") -> Column:
    """Uniform on [0, 1): the first 32 bits of the md5 of the key's parts joined by ``|``."""
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    parts = [seed.cast("string"), *(k.cast("string") for k in key)] + ([F.lit(stream)] if stream else [])
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def uniform(u: Column, lo: Column, hi: Column) -> Column:
    return lo + u * (hi - lo)


def standard_normal(u1: Column, u2: Column) -> Column:
    """Box-Muller on two uniforms; the first is kept off zero."""
    return F.sqrt(-2 * F.ln(u1 + F.lit(0.5 / 4294967296.0))) * F.cos(F.lit(2 * math.pi) * u2)


def normal(z: Column, mean: Column, sigma: Column) -> Column:
    return mean + sigma * z


def lognormal(z: Column, mu: Column, sigma: Column) -> Column:
    return F.exp(mu + sigma * z)


def lognormal_parameters(mean: Column, error_factor: Column, level: float) -> tuple[Column, Column]:
    """(mu, sigma) from mean, error factor and one-sided confidence level."""
    sigma = F.ln(error_factor) / F.lit(NormalDist().inv_cdf(level))
    return F.ln(mean) - sigma * sigma / 2, sigma


def histogram(u: Column, v: Column, bounds: list[float], weights: list[float]) -> Column:
    """A bin by the cumulative weights, then uniform within it."""
    total, lower, out = sum(weights), 0.0, None
    for lo, hi, w in zip(bounds[:-1], bounds[1:], weights, strict=True):
        lower += w / total
        value = F.lit(lo) + v * F.lit(hi - lo)
        out = F.when(u < lower, value) if out is None else out.when(u < lower, value)
    return out.otherwise(F.lit(bounds[-2]) + v * F.lit(bounds[-1] - bounds[-2]))


def mean(op: str, *args: float) -> float:
    """The mean of a deviate by its arguments' values."""
    if op == "uniform-deviate":
        return (args[0] + args[1]) / 2
    if op == "normal-deviate":
        return args[0]
    if op == "lognormal-deviate":
        return args[0] if len(args) == 3 else math.exp(args[0] + args[1] ** 2 / 2)
    if op == "gamma-deviate":
        return args[0] * args[1]
    if op == "beta-deviate":
        return args[0] / (args[0] + args[1])
    if op == "histogram":
        n = len(args) // 2
        bounds, weights = args[: n + 1], args[n + 1 :]
        return sum(w * (a + b) / 2 for a, b, w in zip(bounds[:-1], bounds[1:], weights, strict=True)) / sum(weights)
    raise ValueError(op)


@F.pandas_udf(T.DoubleType())
def normal_quantile(level):
    """Quantile of the standard normal distribution; null outside (0, 1). Levels that occur more than once are looked up."""
    import pandas as pd

    known = {x: NormalDist().inv_cdf(x) for x in level.dropna().unique() if 0 < x < 1}
    return pd.Series(level.map(known), dtype=float)


def _hashed(*words: np.ndarray) -> np.ndarray:
    """Words of 64 bits from integer arrays, one finalised multiplication after another."""
    out = np.zeros(np.broadcast_shapes(*(w.shape for w in words)), np.uint64)
    for w in words:
        out = (out ^ w.astype(np.int64).view(np.uint64)) + np.uint64(0x9E3779B97F4A7C15)
        out = (out ^ (out >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        out = (out ^ (out >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out ^= out >> np.uint64(31)
    return out


def _unit(*key: np.ndarray) -> np.ndarray:
    """Uniforms inside (0, 1), one for each key."""
    return ((_hashed(*key) >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)


def _log_gamma_draws(shape: np.ndarray, *key: np.ndarray) -> np.ndarray:
    """Logarithms of gamma draws of scale 1 for whole arrays, by squeezed normals; a rejected draw takes its next counter.

    A shape below 1 is drawn at 1 higher and scaled by a uniform's power, as a logarithm, so that it cannot become zero.
    """
    word = lambda n: np.full(1, n)
    d = np.where(shape < 1, shape + 1, shape) - 1 / 3
    c, out, todo, counter = 1 / np.sqrt(9 * d), np.empty(len(shape)), np.arange(len(shape)), 0
    while len(todo):
        mine = [k[todo] for k in key]
        u1, u2, u = (_unit(*mine, word(3 * counter + i)) for i in range(3))
        z = np.sqrt(-2 * np.log(u1)) * np.cos(2 * math.pi * u2)
        base = 1 + c[todo] * z
        v = np.where(base > 0, base, 1.0) ** 3
        good = (base > 0) & (np.log(u) < z * z / 2 + d[todo] * (1 - v + np.log(v)))
        out[todo[good]] = np.log(d[todo[good]] * v[good])
        todo, counter = todo[~good], counter + 1
    low = shape < 1
    out[low] += np.log(_unit(*[k[low] for k in key], word(-1))) / shape[low]
    return out


def _drawn(draw, seed, trial, node, a, b):
    """``draw`` on the rows whose two parameters are above zero, null for the others."""
    import pandas as pd

    a, b = a.to_numpy(float, na_value=np.nan), b.to_numpy(float, na_value=np.nan)
    good = (a > 0) & (b > 0) & np.isfinite(a) & np.isfinite(b)
    key = [np.asarray(x, np.int64)[good] for x in (seed, trial, node)]
    out = np.full(len(a), np.nan)
    out[good] = draw(a[good], b[good], *key)
    return pd.Series(out)


@F.pandas_udf(T.DoubleType())
def gamma(seed, trial, node, k, theta):
    """Gamma draws keyed by (seed, trial, node); no closed form as a column. Null unless both parameters are above zero."""
    return _drawn(lambda shape, scale, *key: np.exp(_log_gamma_draws(shape, *key) + np.log(scale)), seed, trial, node, k, theta)


@F.pandas_udf(T.DoubleType())
def beta(seed, trial, node, a, b):
    """Beta draws keyed by (seed, trial, node), a share of two gamma draws. Null unless both parameters are above zero."""

    def share(x: np.ndarray, y: np.ndarray, *key: np.ndarray) -> np.ndarray:
        first, second = (_log_gamma_draws(s, *key, np.full(len(s), stream)) for s, stream in ((x, 1), (y, 2)))
        return np.exp(first - np.logaddexp(first, second))

    return _drawn(share, seed, trial, node, a, b)
