"""Cut sets, prime implicants and substitutions against brute force."""

import itertools

import pytest
from pyspark.sql import functions as F

from riskweave.plans import exact, model, products
from riskweave.settings import Settings
from tests.test_exact import random_graphs, truth
from tests.test_model import load


def value(gates, args, root, x):
    v = {"__true__": True, "__false__": False, **x}
    for name, kind, low, high in gates:
        if name.split(".")[0] == root.split(".")[0]:
            v[name] = truth(kind, [v[a] != c for g, _, a, c in args if g == name], low, high)
    return v[root]


def primes(gates, args, events, root):
    """All minimal partial assignments that make the root true."""
    names, found = [e for e, _ in events], []
    states = {xs: value(gates, args, root, dict(zip(names, xs))) for xs in itertools.product([False, True], repeat=len(names))}
    for given in sorted(itertools.product([None, False, True], repeat=len(names)), key=lambda g: sum(x is not None for x in g)):
        if all(v for xs, v in states.items() if all(g is None or g == x for g, x in zip(given, xs))):
            lits = {("" if g else "!") + n for n, g in zip(names, given) if g is not None}
            if not any(f <= lits for f in found):
                found.append(lits)
    return {tuple(sorted(f)) for f in found}


def test_prime_implicants(spark):
    gates, args, events, roots = random_graphs(25, 11)
    g = exact.Graph(spark.createDataFrame(gates, "id string, connective string, min_num int, max_num int"), spark.createDataFrame(args, "gate_id string, ordinal int, arg_id string, complement boolean"), spark.createDataFrame(events, "id string, p double"))
    found = products.of_graph(g, spark.createDataFrame([(r,) for r in roots], "id string"), Settings(prime_implicants=True, cut_off=0.0)).collect()
    got = {}
    for r in found:
        got.setdefault(r.root, set()).add(tuple(sorted(r["product"])))
        p = dict(events)
        want = 1.0
        for lit in r["product"]:
            want *= 1 - p[lit[1:]] if lit.startswith("!") else p[lit]
        assert r.p == pytest.approx(want)
    assert got == {r: x for r in roots if (x := primes(gates, args, events, r))}


def minimal_failures(gates, args, events, root):
    names = [e for e, _ in events]
    sets = sorted((s for n in range(len(names) + 1) for s in itertools.combinations(names, n)), key=len)
    found = []
    for s in sets:
        if not any(f <= set(s) for f in found) and value(gates, args, root, {n: n in s for n in names}):
            found.append(set(s))
    return {tuple(sorted(f)) for f in found}


def coherent(n):
    gates, args = [], []
    for r in range(n):
        for k, (kind, low) in enumerate([("and", None), ("or", None), ("atleast", 2), (("and", "or", "atleast")[r % 3], 2 if r % 3 == 2 else None)]):
            gates.append((f"g{r}.{k}", kind, low, None))
            pool = [f"e{(r * 7 + k * 3 + j * (r % 4 + 1)) % 6}" for j in range(3)]
            chosen = list(dict.fromkeys(pool[: 2 if k < 2 else 3] + [f"g{r}.{j}" for j in range(k)]))
            args += [(f"g{r}.{k}", i, a, False) for i, a in enumerate(chosen)]
    return gates, args, [(f"e{i}", 0.1 * (i + 1)) for i in range(6)], [f"g{r}.3" for r in range(n)]


def test_cut_sets_and_limits(spark):
    gates, args, events, roots = coherent(12)
    g = exact.Graph(spark.createDataFrame(gates, "id string, connective string, min_num int, max_num int"), spark.createDataFrame(args, "gate_id string, ordinal int, arg_id string, complement boolean"), spark.createDataFrame(events, "id string, p double"))
    root = spark.createDataFrame([(r,) for r in roots], "id string")
    gather = lambda rows: {(r.root, tuple(sorted(r["product"]))): r.p for r in rows.collect()}
    every = gather(products.of_graph(g, root, Settings(cut_off=0.0)))
    assert set(every) == {(r, s) for r in roots for s in minimal_failures(gates, args, events, r)}
    p = dict(events)
    weight = lambda s: __import__("math").prod(p[e] for e in s)
    assert every == {k: pytest.approx(weight(k[1])) for k in every}
    assert set(gather(products.of_graph(g, root, Settings(cut_off=0.0, limit_order=2)))) == {k for k in every if len(k[1]) <= 2}
    assert set(gather(products.of_graph(g, root, Settings(cut_off=0.05)))) == {k for k in every if weight(k[1]) >= 0.05}


MODEL = """<define-gate name="top"><atleast min="2"><basic-event name="A"/><basic-event name="B"/><basic-event name="C"/></atleast></define-gate>
  <define-basic-event name="A"><float value="0.1"/></define-basic-event><define-basic-event name="B"><float value="0.2"/></define-basic-event><define-basic-event name="C"><float value="0.3"/></define-basic-event>"""
SUBS = """<opsa-mef><define-fault-tree name="X"><define-basic-event name="R" role="public"><float value="0.5"/></define-basic-event></define-fault-tree>
  <define-substitution name="never" type="delete-terms"><hypothesis><and><basic-event name="A"/><basic-event name="B"/></and></hypothesis><target><constant value="false"/></target></define-substitution>
  <define-substitution name="swap" type="exchange-event"><hypothesis><and><basic-event name="B"/><basic-event name="C"/></and></hypothesis><source><basic-event name="C"/></source><target><basic-event name="R"/></target></define-substitution>
  <define-substitution name="help" type="recovery-rule"><hypothesis><and><basic-event name="A"/><basic-event name="C"/></and></hypothesis><target><basic-event name="R"/></target></define-substitution></opsa-mef>"""


def test_substitutions_of_a_model(spark, tmp_path):
    m = load(spark, tmp_path, f"<opsa-mef><define-fault-tree name='T'>{MODEL}</define-fault-tree></opsa-mef>", SUBS, settings=Settings(approximation="rare-event"))
    assert m.violations.collect() == []
    assert {tuple(r["product"]): r.p for r in products.cut_sets(m).collect()} == {("B", "R"): pytest.approx(0.1), ("A", "C", "R"): pytest.approx(0.015)}
    assert {r.id: r.p for r in products.probabilities(m).collect()} == {"top": pytest.approx(0.115)}
    m.settings = Settings()
    assert {r.id: r.p for r in products.probabilities(m).collect()} == {"top": pytest.approx(0.02 + 0.03 + 0.06 - 2 * 0.006)}
    m.settings = Settings(approximation="mcub")
    m.tables["substitutions"] = m.substitutions.where("false")
    assert {r.id: r.p for r in products.probabilities(m).collect()} == {"top": pytest.approx(1 - 0.98 * 0.97 * 0.94)}


def test_absorption_in_rows_and_by_joins(spark, monkeypatch):
    """Roots with few sets and roots with many are absorbed alike, further columns kept; few sets need no joins."""
    from riskweave.plans import quantify

    rows = [("a", ["x"], 1), ("a", ["x", "y"], 2), ("a", ["y", "z"], 3), ("b", [], 4), ("b", ["x"], 5), ("c", ["x"], 6)]
    cuts = spark.createDataFrame(rows, "root string, cut array<string>, n int")
    few = quantify.minimal(cuts)
    assert sorted(r.n for r in few.collect()) == [1, 3, 4, 6]
    assert "Join" not in few._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(quantify, "TOGETHER", 1)
    assert sorted(r.n for r in quantify.minimal(cuts).collect()) == [1, 3, 4, 6]


def test_cut_sets_of_flat_gates_need_no_rounds(spark, monkeypatch):
    """Gates over events only are done within their rows, with the same sets as by rounds; other gates beside them go on as before."""
    kinds = [("and", None), ("or", None), ("atleast", 2), ("atleast", 3), ("null", None), ("not", None), ("nand", None), ("nor", None), ("imply", None)]
    gates, args = [], []
    for r, (kind, low) in enumerate(kinds * 2):
        gates.append((f"f{r}", kind, low, None))
        names = [f"e{(r + 2 * i) % 6}" for i in range({"null": 1, "not": 1, "imply": 2}.get(kind, 5))]
        names = [*names[:-1], "__true__" if r % 2 else "__false__"] if r >= len(kinds) and len(names) > 2 else list(dict.fromkeys(names))
        args += [(f"f{r}", i, a, r >= len(kinds) and i == 1) for i, a in enumerate(names)]
    events, roots = [(f"e{i}", 0.1 * (i + 1)) for i in range(5)] + [("e5", None)], [g[0] for g in gates]
    frame = lambda gates, args: exact.Graph(
        spark.createDataFrame(gates, "id string, connective string, min_num int, max_num int"), spark.createDataFrame(args, "gate_id string, ordinal int, arg_id string, complement boolean"), spark.createDataFrame(events, "id string, p double")
    )
    root = spark.createDataFrame([(r,) for r in roots], "id string")
    gather = lambda rows: sorted((r.root, tuple(r["product"]), None if r.p is None else round(r.p, 12)) for r in rows.collect())
    for settings in (Settings(cut_off=0.0), Settings(cut_off=0.02), Settings(cut_off=0.0, limit_order=2)):
        monkeypatch.setattr(products, "IN_ROW", 0, raising=False)
        by_rounds = gather(products.of_graph(frame(gates, args), root, settings))
        monkeypatch.setattr(products, "IN_ROW", 128, raising=False)
        mixed = (gates + [("top", "xor", None, None)], args + [("top", 0, "f0", False), ("top", 1, "f1", False)])
        assert gather(products.of_graph(frame(*mixed), root, settings)) == by_rounds
        with monkeypatch.context() as m:
            m.setattr(products, "expand", lambda *_: pytest.fail("rounds for flat gates"))
            rest = [i for i, r in enumerate(roots) if len({a for g, _, a, _ in args if g == r}) == sum(g == r for g, *_ in args)]
            keep = {roots[i] for i in rest}
            flat = frame([g for g in gates if g[0] in keep], [a for a in args if a[0] in keep])
            assert gather(products.of_graph(flat, root, settings)) == [x for x in by_rounds if x[0] in keep]


def test_a_target_of_many_substitutions_is_looked_up_once(spark, tmp_path, monkeypatch):
    seen, real = [], model.references.resolve
    monkeypatch.setattr(model.references, "resolve", lambda refs, entities: seen.append(sorted(r.ref for r in refs.select("ref").collect())) or real(refs, entities))
    twice = SUBS.replace("</opsa-mef>", "<define-substitution name='odd'><hypothesis><and><basic-event name='A'/><basic-event name='A'/></and></hypothesis><target><basic-event name='none'/></target></define-substitution></opsa-mef>")
    m = load(spark, tmp_path, f"<opsa-mef><define-fault-tree name='T'>{MODEL}</define-fault-tree></opsa-mef>", twice, settings=Settings(approximation="rare-event"))
    assert {(r.name, r.target_event, tuple(r.source)) for r in m.substitutions.collect()} == {("never", None, ()), ("swap", "R", ("C",)), ("help", "R", ()), ("odd", None, ())}
    assert ["R", "none"] in seen and ["R", "R", "none"] not in seen
    assert {(r.code, r.entity, r.detail) for r in m.violations.collect()} >= {("DuplicateElementError", "odd", "argument given twice: A"), ("UndefinedElement", "none", "event of substitution odd")}
