"""Diagrams against enumeration of all states, importance against differences, scenarios of house events."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from riskweave.plans import exact, simplify

KINDS = ("and", "or", "atleast", "xor", "not", "nand", "nor", "null", "iff", "imply", "cardinality")


def random_graphs(n_roots, seed):
    """Gates with repeated events and shared gates under several roots: (gates, args, events, roots)."""
    rng = random.Random(seed)
    events = [(f"e{i}", rng.choice([0.0, 0.1, 0.5, 0.9, 1.0, rng.random()])) for i in range(5)]
    gates, args = [], []
    for r in range(n_roots):
        names = [f"g{r}.{k}" for k in range(4)]
        for k, name in enumerate(names):
            pool = [e for e, _ in events] + names[:k] * 2 + ["__true__", "__false__"] * (rng.random() < 0.2)
            kind = rng.choice(KINDS)
            size = {"not": 1, "null": 1, "xor": 2, "iff": 2, "imply": 2}.get(kind, 3)
            chosen = rng.sample(sorted(set(pool)), size)
            if k == 3:
                chosen[0] = names[2]
            low, high = (2, None) if kind == "atleast" else (1, 2) if kind == "cardinality" else (None, None)
            gates.append((name, kind, low, high))
            args += [(name, i, a, kind not in ("not", "null") and rng.random() < 0.3) for i, a in enumerate(dict.fromkeys(chosen))]
    return gates, args, events, [f"g{r}.3" for r in range(n_roots)]


def truth(kind, xs, low, high):
    t, n = sum(xs), len(xs)
    return {"and": t == n, "or": t > 0, "null": t > 0, "atleast": t >= (low or 0), "xor": t == 1, "not": t == 0, "nor": t == 0, "nand": t < n, "iff": t != 1, "imply": not xs[0] or xs[-1], "cardinality": (low or 0) <= t <= (high or 0)}[kind]


def enumerate_states(gates, args, events, root, fixed=None):
    total = 0.0
    for xs in itertools.product([False, True], repeat=len(events)):
        value, w = {"__true__": True, "__false__": False}, 1.0
        for (e, p), x in zip(events, xs):
            p = (fixed or {}).get(e, p)
            value[e], w = x, w * (p if x else 1 - p)
        for name, kind, low, high in gates:
            if name.split(".")[0] == root.split(".")[0]:
                value[name] = truth(kind, [value[a] != c for g, _, a, c in args if g == name], low, high)
        total += w * value[root]
    return total


@pytest.fixture(scope="module")
def random_case(spark):
    gates, args, events, roots = random_graphs(40, 3)
    g = exact.Graph(spark.createDataFrame(gates, "id string, connective string, min_num int, max_num int"), spark.createDataFrame(args, "gate_id string, ordinal int, arg_id string, complement boolean"), spark.createDataFrame(events, "id string, p double"))
    return gates, args, events, roots, g


def test_against_enumeration(spark, random_case):
    gates, args, events, roots, g = random_case
    events_found, whole = exact.derivatives(g, spark.createDataFrame([(r,) for r in roots], "id string"))
    got = {r.id: r.p for r in whole.collect()}
    assert got == {r: pytest.approx(enumerate_states(gates, args, events, r), abs=1e-12) for r in roots}
    slopes = {(r.root, r.id): r.birnbaum for r in events_found.collect()}
    for root in roots:
        for e, _ in events:
            d = enumerate_states(gates, args, events, root, {e: 1.0}) - enumerate_states(gates, args, events, root, {e: 0.0})
            assert slopes.get((root, e), 0.0) == pytest.approx(d, abs=1e-12)


def test_unknown_and_empty(spark):
    g = exact.Graph(
        spark.createDataFrame([("t", "and", None, None), ("a", "or", None, None), ("b", "or", None, None)], "id string, connective string, min_num int, max_num int"),
        spark.createDataFrame([("t", 0, "a", False), ("t", 1, "b", False), ("a", 0, "x", False), ("a", 1, "y", False), ("b", 0, "x", False), ("b", 1, "z", False)], "gate_id string, ordinal int, arg_id string, complement boolean"),
        spark.createDataFrame([("x", 0.5), ("y", 0.5)], "id string, p double"),
    )
    root = spark.createDataFrame([("t",)], "id string")
    assert [(r.id, r.p) for r in exact.probabilities(g, root).collect()] == [("t", None)]
    full = exact.Graph(g.gates, g.args, spark.createDataFrame([("x", 0.5), ("y", 0.5), ("z", 0.5)], "id string, p double"))
    rows = {r.id: r for r in exact.importance(full, root).collect()}
    assert rows["x"].birnbaum == pytest.approx(0.75) and rows["x"].achievement == pytest.approx(1 / 0.625) and rows["x"].critical == pytest.approx(0.75 * 0.5 / 0.625)
    assert rows["y"].birnbaum == pytest.approx(0.25) and rows["y"].reduction == pytest.approx(0.625 / 0.5) and rows["y"].diagnosis == pytest.approx(0.5 * 0.75 / 0.625)
    assert exact.probabilities(full, root.where("false")).count() == 0


def test_phases(spark, tmp_path):
    from tests.test_model import load

    m = load(spark, tmp_path, """<define-fault-tree name="F"><define-house-event name="h"><constant value="false"/></define-house-event>
      <define-gate name="top"><or><gate name="left"/><gate name="right"/></or></define-gate>
      <define-gate name="left"><and><basic-event name="A"/><house-event name="h"/></and></define-gate>
      <define-gate name="right"><and><basic-event name="A"/><basic-event name="B"/></and></define-gate>
      <define-basic-event name="A"><float value="0.5"/></define-basic-event><define-basic-event name="B"><float value="0.2"/></define-basic-event></define-fault-tree>
      <define-alignment name="year"><define-phase name="up" time-fraction="0.75"/><define-phase name="down" time-fraction="0.25"><set-house-event name="h"><constant value="true"/></set-house-event></define-phase></define-alignment>""")
    assert m.violations.collect() == []
    by_phase = exact.phase_probabilities(m)
    assert {(r.phase, r.id): r.p for r in by_phase.collect()} == {("up", "top"): pytest.approx(0.1), ("down", "top"): pytest.approx(0.5)}
    assert [(r.alignment, r.p) for r in exact.over_phases(by_phase).collect()] == [("year", pytest.approx(0.75 * 0.1 + 0.25 * 0.5))]
    assert {r.id: r.p for r in exact.model_probabilities(m).collect()} == {"top": pytest.approx(0.1)}


def test_simplified(spark, random_case):
    gates, args, events, roots, g = random_case
    root = spark.createDataFrame([(r,) for r in roots], "id string")
    got = {r.id: r.p for r in simplify.probabilities(g, root).collect()}
    assert got == {r: pytest.approx(enumerate_states(gates, args, events, r), abs=1e-12) for r in roots}
    small, ends = simplify.simplified(g, root)
    assert small.gates.count() < len(gates) and ends.count() == len(roots)
    left = {r.id for r in small.gates.collect()}
    assert not {r.arg_id for r in small.args.collect()} & {"__true__", "__false__"} and all(r.gate_id in left for r in small.args.collect())
