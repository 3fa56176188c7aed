"""Uncertainty and integrity levels of models."""

import math

import pytest

from riskweave.plans import analyses, exact
from riskweave.settings import Settings
from tests.test_model import load

MODEL = """<define-gate name="top"><or><gate name="a"/><gate name="b"/></or></define-gate>
  <define-gate name="a"><and><basic-event name="X"/><basic-event name="Y"/></and></define-gate><define-gate name="b"><and><basic-event name="X"/><basic-event name="m1"/></and></define-gate>
  <define-basic-event name="X"><exponential><float value="1e-4"/><system-mission-time/></exponential></define-basic-event>
  <define-basic-event name="Y"><uniform-deviate><float value="0.1"/><float value="0.5"/></uniform-deviate></define-basic-event>
  <define-CCF-group name="c" model="beta-factor"><members><basic-event name="m1"/><basic-event name="m2"/></members><distribution><uniform-deviate><float value="0.1"/><float value="0.3"/></uniform-deviate></distribution><factor><float value="0.5"/></factor></define-CCF-group>"""


def exact_top(x, y, total):
    m = 1 - (1 - 0.5 * total) ** 2
    return x * (1 - (1 - y) * (1 - m))


def test_integrity_and_uncertainty(spark, tmp_path):
    m = load(spark, tmp_path, MODEL, settings=Settings(mission_time=1000.0, time_step=300.0, num_trials=200, num_quantiles=4, num_bins=5, seed=3))
    assert m.violations.collect() == []
    timed = {r.time: r.p for r in analyses.over_time(m).collect()}
    want = {t: exact_top(1 - math.exp(-1e-4 * t), 0.3, 0.2) for t in (0.0, 300.0, 600.0, 900.0, 1000.0)}
    assert timed == {t: pytest.approx(p) for t, p in want.items()}
    (row,) = analyses.integrity(spark.createDataFrame([("top", t, p) for t, p in want.items()], "id string, time double, p double")).collect()
    points = sorted(want.items())
    assert row.average == pytest.approx(sum((b - a) * (p + q) / 2 for (a, p), (b, q) in zip(points, points[1:])) / 1000) and row.level == 1
    assert sum(row.shares) == pytest.approx(1.0) and row.shares[0] == 0.0 and row.shares[4] > 0

    sampled = analyses.trial_probabilities(m).collect()
    assert sorted(r.trial for r in sampled) == list(range(200))
    x, low, high = 1 - math.exp(-0.1), exact_top(1 - math.exp(-0.1), 0.1, 0.1), exact_top(1 - math.exp(-0.1), 0.5, 0.3)
    assert all(low <= r.p <= high for r in sampled) and len({r.p for r in sampled}) == 200
    assert sum(r.p for r in sampled) / 200 == pytest.approx(exact_top(x, 0.3, 0.2), rel=0.05)
    frame = spark.createDataFrame([(r.id, r.trial, r.p) for r in sampled], "id string, trial int, p double")
    moments, quantiles, bins = (d.collect() for d in analyses.uncertainty(frame, 4, 5))
    ps = sorted(r.p for r in sampled)
    assert moments[0].trials == 200 and moments[0].mean == pytest.approx(sum(ps) / 200)
    assert [r.p for r in sorted(quantiles, key=lambda r: r.quantile)][-1] == ps[-1] and len(quantiles) == 4
    assert sum(r.trials for r in bins) == 200 and min(r.lower for r in bins) == ps[0] and max(r.upper for r in bins) == pytest.approx(ps[-1])
    same = spark.createDataFrame([("g", i, 0.25) for i in range(5)], "id string, trial int, p double")
    assert [(r.bin, r.trials) for r in analyses.uncertainty(same, 2, 3)[2].collect()] == [(1, 5)]


def test_times_go_together_and_groups_that_no_gate_is_over_make_no_events(spark, tmp_path, monkeypatch):
    free = """<define-gate name="top"><or><gate name="a"/><basic-event name="Y"/></or></define-gate><define-gate name="a"><and><basic-event name="X"/><not><basic-event name="Z"/></not></and></define-gate>
      <define-gate name="two"><atleast min="2"><basic-event name="X"/><basic-event name="Y"/><basic-event name="Z"/></atleast></define-gate><define-gate name="same"><or><gate name="a"/><basic-event name="X"/></or></define-gate>
      <define-basic-event name="X"><exponential><float value="1e-3"/><system-mission-time/></exponential></define-basic-event><define-basic-event name="Y"><float value="0.25"/></define-basic-event><define-basic-event name="Z"><float value="0.5"/></define-basic-event>
      <define-CCF-group name="c" model="beta-factor"><members><basic-event name="m1"/><basic-event name="m2"/></members><distribution><float value="0.1"/></distribution><factor><float value="0.5"/></factor></define-CCF-group>"""
    m = load(spark, tmp_path, free, settings=Settings(mission_time=1000.0, time_step=500.0))
    m.combined = lambda _: pytest.fail("events of a group without need")
    roots = []
    monkeypatch.setattr(exact, "_repeated", lambda g, points, shared, rounds, real=exact._repeated: roots.extend(r.id for r in shared.collect()) or real(g, points, shared, rounds))
    got = {(r.id, r.time): r.p for r in analyses.over_time(m).collect()}
    x = {t: 1 - math.exp(-1e-3 * t) for t in (0.0, 500.0, 1000.0)}
    want = {("top", t): 1 - (1 - 0.5 * x) * 0.75 for t, x in x.items()} | {("two", t): 0.75 * x * 0.5 + 0.25 * x * 0.5 + (1 - x) * 0.125 + x * 0.125 for t, x in x.items()} | {("same", t): x for t, x in x.items()}
    assert got == {k: pytest.approx(p) for k, p in want.items()}
    assert roots == ["same"]
