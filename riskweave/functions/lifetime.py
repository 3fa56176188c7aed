"""Failure probabilities by lifetime laws, after published reliability literature."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def exponential(rate: Column, t: Column) -> Column:
    """1 - exp(-rate t), without cancellation for small products."""
    return -F.expm1(-rate * t)


def glm(gamma: Column, rate: Column, mu: Column, t: Column) -> Column:
    """Failure on demand gamma, failure rate, repair rate mu."""
    both = rate + mu
    return (rate - (rate - gamma * both) * F.exp(-both * t)) / both


def weibull(scale: Column, shape: Column, t0: Column, t: Column) -> Column:
    return F.when(t > t0, 1 - F.exp(-F.pow((t - t0) / scale, shape))).otherwise(F.lit(0.0))


def periodic_test_instant(rate: Column, tau: Column, theta: Column, t: Column) -> Column:
    """Tests every tau from theta on, with instant repair."""
    return F.when(t <= theta, exponential(rate, t)).otherwise(exponential(rate, (t - theta) - tau * F.floor((t - theta) / tau)))


def _cycle(working: Column, failed: Column, repair: Column, rate: Column, mu: Column, dt: Column) -> tuple[Column, Column, Column]:
    """Working, failed and repaired shares after dt of a test cycle: failures stay hidden, repairs end in working."""
    e_rate, e_mu = F.exp(-rate * dt), F.exp(-mu * dt)
    close = F.abs(mu - rate) < 1e-12 * F.greatest(F.abs(mu), F.abs(rate))
    still = repair * e_mu
    moved = F.when(close, repair * mu * dt * e_rate).otherwise(repair * mu * (e_rate - e_mu) / F.when(close, F.lit(1.0)).otherwise(mu - rate))
    now = working * e_rate + moved
    return now, failed + (working + repair - now - still), still


def periodic_test_repair(rate: Column, mu: Column, tau: Column, theta: Column, t: Column) -> Column:
    """Tests every tau from theta on reveal failures, whose repair takes a time of rate mu: unavailability at t."""
    def state(w: Column, f: Column, r: Column) -> Column:
        return F.struct(w.alias("w"), f.alias("f"), r.alias("r"))

    one, zero = F.lit(1.0), F.lit(0.0)
    first = state(*_cycle(one, zero, zero, rate, mu, F.least(t, theta)))
    tests = F.when(t > theta, F.floor((t - theta) / tau).cast("int")).otherwise(F.lit(0))
    step = lambda s, _: state(*_cycle(s["w"], zero, s["r"] + s["f"], rate, mu, tau))
    after = F.aggregate(F.when(tests > 0, F.sequence(F.lit(1), tests)).otherwise(F.array().cast("array<int>")), first, step)
    rest = (t - theta) - tau * tests
    last = lambda s: _cycle(s["w"], zero, s["r"] + s["f"], rate, mu, rest)
    ended = F.transform(F.array(after), lambda s: last(s)[1] + last(s)[2])[0]
    return F.when(t <= theta, first["f"]).otherwise(ended)


def _bound(value: Column, f) -> Column:
    """f(value), with the value computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _repaired(repair: Column, mu: Column, rate: Column, dt: Column) -> Column:
    """Of the share in repair, what is repaired within dt and has not failed since at the given rate."""
    close = F.abs(mu - rate) < 1e-12 * F.greatest(F.abs(mu), F.abs(rate))
    e_rate, e_mu = F.exp(-rate * dt), F.exp(-mu * dt)
    return repair * mu * F.when(close, dt * e_rate).otherwise((e_rate - e_mu) / F.when(close, F.lit(1.0)).otherwise(mu - rate))


def periodic_test_full(
    rate: Column, test_rate: Column, mu: Column, tau: Column, theta: Column, gamma: Column, duration: Column, available: Column, sigma: Column, omega: Column, t: Column
) -> Column:
    """Tests every tau from theta on that take a while, can break the component and can overlook a failure: unavailability at t.

    A multi-phase Markov graph of the states working, failed, in repair, and under test while working or failed. At the
    start of a test a working component fails with probability gamma; under test it fails at ``test_rate``. At its end a
    working component fails to restart with probability omega, a failure is found, and its repair begun, with
    probability sigma. A repair takes a time of rate mu and, too, fails to restart with omega. What is in repair when
    a test starts is left out of it. A working component under test counts only where ``available`` is not 0.
    """

    def state(w: Column, f: Column, r: Column, tw: Column, tf: Column) -> Column:
        return F.struct(w.alias("w"), f.alias("f"), r.alias("r"), tw.alias("tw"), tf.alias("tf"))

    def between(s: Column, dt: Column) -> Column:
        """The shares dt later; all failures outside a test are hidden until the next."""
        still = s["r"] * F.exp(-mu * dt)
        working = s["w"] * F.exp(-rate * dt) + (1 - omega) * _repaired(s["r"], mu, rate, dt)
        tested = s["tw"] * F.exp(-test_rate * dt)
        return state(working, s["f"] + s["w"] + s["r"] - working - still, still, tested, s["tf"] + s["tw"] - tested)

    zero = F.lit(0.0)

    def since_test(s: Column, dt: Column) -> Column:
        """The shares dt after the start of a test, from those just before it."""
        begun = state(zero, zero, s["r"], (1 - gamma) * s["w"], s["f"] + gamma * s["w"])
        under = between(begun, F.least(dt, duration))
        ended = lambda x: state(x["w"] + (1 - omega) * x["tw"], x["f"] + omega * x["tw"] + (1 - sigma) * x["tf"], x["r"] + sigma * x["tf"], zero, zero)
        later = lambda x: F.when(dt < duration, x).otherwise(_bound(ended(x), lambda y: between(y, dt - duration)))
        return _bound(under, later)

    cycles = F.when(t > theta, F.floor((t - theta) / tau).cast("int")).otherwise(F.lit(0))
    start = between(state(F.lit(1.0), zero, zero, zero, zero), F.least(t, theta))
    whole = F.when(cycles > 0, F.sequence(F.lit(1), cycles)).otherwise(F.array().cast("array<int>"))
    before = F.aggregate(whole, start, lambda s, _: since_test(s, tau))
    at = lambda s: since_test(s, (t - theta) - tau * cycles)
    out = lambda s: s["f"] + s["r"] + s["tf"] + F.when(available != 0, zero).otherwise(s["tw"])
    return F.when(t <= theta, exponential(rate, t)).otherwise(_bound(_bound(before, at), out))


#: name -> (number of arguments, column)
LAWS = {"exponential": (2, exponential), "GLM": (4, glm), "Weibull": (4, weibull), "periodic-test/4": (4, periodic_test_instant), "periodic-test/5": (5, periodic_test_repair), "periodic-test/11": (11, periodic_test_full)}
