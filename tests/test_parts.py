"""Golden numbers, identities and small models for the operators."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave import errors, streaming
from riskweave.functions import deviates, intervals, lifetime, numeric
from riskweave.operators import ccf, elements, externs, formulas, graphs, references, substitutions
from riskweave.plans import quantify

P = (0.1, 0.2, 0.3)


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_connectives(spark):
    """Probabilities against truth tables, for up to 4 arguments."""
    cases = []
    for n in range(1, 5):
        for c, (least, most) in formulas.CONNECTIVES.items():
            if n < least or (most and n > most) or (c == "atleast" and n < 3):
                continue
            cases.append((c, n, 2 if c == "atleast" else 1 if c == "cardinality" else None, min(2, n) if c == "cardinality" else None))
    ps = (0.1, 0.2, 0.3, 0.45)
    truth = {
        "and": all, "or": any, "nand": lambda x: not all(x), "nor": lambda x: not any(x), "not": lambda x: not x[0], "null": lambda x: x[0], "xor": lambda x: sum(x) == 1, "iff": lambda x: x[0] == x[1],
        "imply": lambda x: not x[0] or x[1], "atleast": lambda x: sum(x) >= 2, "cardinality": lambda x: 1 <= sum(x) <= 2,
    }
    rows = spark.createDataFrame([(i, c, list(ps[:n]), lo, hi) for i, (c, n, lo, hi) in enumerate(cases)], "i int, c string, p array<double>, lo int, hi int")
    got = {r.i: r.v for r in rows.select("i", formulas.probability(F.col("c"), F.col("p"), F.col("lo"), F.col("hi")).alias("v")).collect()}
    for i, (c, n, *_) in enumerate(cases):
        want = sum(math.prod(p if x else 1 - p for p, x in zip(ps, xs, strict=False)) for xs in itertools.product((False, True), repeat=n) if truth[c](xs))
        assert got[i] == pytest.approx(want), (c, n)


def test_lifetime(spark):
    t, c = F.lit(8760.0), lambda x: F.lit(float(x))
    r = one(
        spark, lifetime.exponential(c(1e-4), t), lifetime.glm(c(0.01), c(1e-4), c(0.1), t), lifetime.weibull(c(10000), c(1.5), c(100), t), lifetime.periodic_test_instant(c(1e-4), c(720), c(100), t),
        lifetime.periodic_test_repair(c(1e-3), c(0.05), c(100), c(50), c(495)), lifetime.periodic_test_repair(c(1e-3), c(0.05), c(100), c(50), c(20)),
    )
    assert list(r)[:4] == pytest.approx([0.58355463398, 0.000999000999, 0.553310692608, 0.001998001333], rel=1e-9)
    w, f, rep, clock, rate, mu, dt = 1.0, 0.0, 0.0, 0.0, 1e-3, 0.05, 0.005
    tests = [50 + 100 * k for k in range(5)]
    while clock < 495 - 1e-9:  # the three states in small steps
        if tests and clock >= tests[0] - 1e-9:
            tests.pop(0)
            rep, f = rep + f, 0.0
        w, f, rep, clock = w + dt * (mu * rep - rate * w), f + dt * rate * w, rep - dt * mu * rep, clock + dt
    assert r[4] == pytest.approx(f + rep, rel=1e-3)
    assert r[5] == pytest.approx(1 - math.exp(-0.02))


def full_test(lam, lam_test, mu, tau, theta, gamma, duration, available, sigma, omega, t, dt=0.002):
    """The five states of a tested component in small steps."""
    w, f, r, tw, tf, clock, start, end = 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, theta, None
    while clock < t - dt / 2:
        if clock >= start - dt / 2:
            tw, tf, w, f = (1 - gamma) * w, f + gamma * w, 0.0, 0.0
            end, start = start + duration, start + tau
        if end is not None and clock >= end - dt / 2:
            w, f, r, tw, tf, end = w + (1 - omega) * tw, f + omega * tw + (1 - sigma) * tf, r + sigma * tf, 0.0, 0.0, None
        w, f, r, tw, tf = w + dt * ((1 - omega) * mu * r - lam * w), f + dt * (lam * w + omega * mu * r), r - dt * mu * r, tw - dt * lam_test * tw, tf + dt * lam_test * tw
        clock += dt
    return f + r + tf + (0 if available else tw)


def test_full_periodic_test(spark):
    c = lambda x: F.lit(float(x))
    base = (2e-3, 5e-3, 0.05, 100, 50, 0.02, 10, 1, 0.9, 0.03)
    away = (*base[:7], 0, *base[8:])
    same = (0.05, 5e-3, 0.05, *base[3:])  # repair as fast as failure
    cases = [(*x, t) for x in (base, away, same) for t in (20, 55, 75, 254, 295)]
    got = one(spark, *[lifetime.periodic_test_full(*map(c, x)) for x in cases])
    for v, x in zip(got, cases, strict=True):
        assert v == pytest.approx(full_test(*x), rel=2e-3), x
    # tests that take no time, find everything and break nothing are the law of five arguments
    plain = one(spark, lifetime.periodic_test_full(*map(c, (1e-3, 0, 0.05, 100, 50, 0, 1e-9, 1, 1, 0, 495))), lifetime.periodic_test_repair(*map(c, (1e-3, 0.05, 100, 50, 495))))
    assert plain[0] == pytest.approx(plain[1], rel=1e-6)
    assert one(spark, lifetime.periodic_test_full(*map(c, base), F.lit(None).cast("double")))[0] is None


GOLDEN = {
    "beta-factor": ([(3, 0.1)], [0.09, None, 0.01]), "MGL": ([(2, 0.1), (3, 0.2)], [0.09, 0.004, 0.002]),
    "alpha-factor": ([(1, 0.9), (2, 0.08), (3, 0.02)], [0.0803571428571, 0.00714285714286, 0.00535714285714]), "phi-factor": ([(1, 0.9), (2, 0.08), (3, 0.02)], [0.09, 0.008, 0.002]),
}


def test_common_causes(spark):
    levels = [(m, m, 3, 0.1, k, f) for m, (fs, _) in GOLDEN.items() for k, f in fs]
    q = ccf.level_probabilities(spark.createDataFrame(levels, "group_id string, model string, n int, q_total double, level int, factor double"))
    got = {(r.group_id, r.level): r.q for r in q.collect()}
    for m, (_, want) in GOLDEN.items():
        for k, x in enumerate(want, 1):
            assert got.get((m, k)) == (None if x is None else pytest.approx(x))
    members = spark.createDataFrame([("alpha-factor", i, e) for i, e in enumerate("ABC")], "group_id string, ordinal int, event_id string")
    events = ccf.expand(members, q)
    assert {r.event_id for r in events.collect()} == {"[A]", "[B]", "[C]", "[A B]", "[A C]", "[B C]", "[A B C]"}
    assert {r.arg_id for r in ccf.proxy_args(events).collect() if r.gate_id == "A"} == {"[A]", "[A B]", "[A C]", "[A B C]"}
    bad = spark.createDataFrame([("x", 2, 4, 2), ("x", 4, 4, 2), ("y", 9, 3, 2)], "group_id string, level int, n int, min_level int")
    assert {(r.group_id, r.problem) for r in ccf.level_problems(bad).collect()} == {("x", "missing level"), ("y", "level out of range"), ("y", "missing level")}


def test_two_member_models_agree(spark):
    rows = [("b", "beta-factor", 2, 0.1, 2, 0.2), ("m", "MGL", 2, 0.1, 2, 0.2), ("a", "alpha-factor", 2, 0.1, 1, 0.8 / 0.9), ("a", "alpha-factor", 2, 0.1, 2, 0.1 / 0.9)]
    q = ccf.level_probabilities(spark.createDataFrame(rows, "group_id string, model string, n int, q_total double, level int, factor double")).collect()
    by = {(r.group_id, r.level): r.q for r in q}
    for other in "ma":
        assert [by[other, 1], by[other, 2]] == pytest.approx([by["b", 1], by["b", 2]])


def test_graphs(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "a"), ("c", "y"), ("p", "q"), ("q", "q")], "a string, b string")
    assert {r.path for r in graphs.cycle_paths(edges).collect()} == {"a->b->c->a", "q->q"}
    placed, left = graphs.levels(spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c")], "a string, b string"))
    assert {(r.node, r.level) for r in placed.collect()} == {("a", 2), ("b", 1), ("c", 0)} and left.count() == 0


def test_references(spark):
    entities = spark.createDataFrame([("G", "public", "T.G", "gate"), ("T.c.X", "private", "T.c.X", "basic-event"), ("X", "public", "T.X", "house-event")], "id string, role string, full_path string, kind string")
    refs = spark.createDataFrame([("T.c", "X"), ("T", "X"), ("Z", "G"), ("Z", "T.c.X"), ("Z", "nope"), ("", "X")], "base_path string, ref string")
    got = {(r.base_path, r.ref): (r.id, r.kind) for r in references.resolve(refs, entities).collect()}
    assert got == {("T.c", "X"): ("T.c.X", "basic-event"), ("T", "X"): ("X", "house-event"), ("Z", "G"): ("G", "gate"), ("Z", "T.c.X"): ("T.c.X", "basic-event"), ("Z", "nope"): (None, None), ("", "X"): ("X", "house-event")}


def test_intervals_and_numbers(spark):
    iv = intervals.Interval.of(-2, 3)
    r = one(spark, intervals.propagate("abs", iv).lo, intervals.propagate("abs", iv, exact_abs=True).lo, intervals.propagate("mul", iv, iv).hi, numeric.apply("mod", F.lit(-7.9), F.lit(3.0)), numeric.apply("switch", F.lit(5.0)), intervals.domain_problem("log", iv))
    assert list(r) == [2.0, 0.0, 9.0, -1.0, 5.0, True]
    with pytest.raises(ValueError, match="takes"):
        numeric.apply("ite", F.lit(1.0))


def test_deviates(spark):
    assert one(spark, deviates.keyed_uniform(42, F.lit(7), F.lit(0)))[0] == 0.8428191791754216
    rows = spark.range(2000).select(deviates.gamma(F.lit(1), "id", F.lit(5), F.lit(2.0), F.lit(3.0)).alias("g"), deviates.beta(F.lit(1), "id", F.lit(6), F.lit(2.0), F.lit(6.0)).alias("b"))
    r = rows.agg(F.avg("g"), F.avg("b")).first()
    assert r[0] == pytest.approx(6.0, rel=0.1) and r[1] == pytest.approx(0.25, rel=0.1)
    assert rows.collect() == rows.collect()


def test_substitutions(spark):
    schema = "name string, connective string, min_num int, hypothesis array<string>, source array<string>, target_event string, target_const boolean, complemented boolean, other_kinds boolean"
    rows = [("d", "and", None, ["a", "b"], [], None, False, False, False), ("r", "and", None, ["a", "b"], ["a", "b"], "c", None, False, False), ("e", "and", None, ["a", "b"], ["b"], "c", None, False, False), ("x", "or", None, ["c"], ["z"], None, False, False, False)]
    subs = spark.createDataFrame(rows, schema)
    assert {r.name: r.kind for r in subs.select("name", substitutions.kind().alias("kind")).collect()} == {"d": "delete-terms", "r": "recovery-rule", "e": "exchange-event", "x": None}
    assert {r.name for r in subs.where(substitutions.problem().isNotNull()).collect()} == {"x"}
    assert ("e", "c", "target in another hypothesis") in {tuple(r) for r in substitutions.conflicts(subs).collect()}


def test_substitution_kinds(spark):
    schema = "name string, connective string, min_num int, hypothesis array<string>, source array<string>, target_event string, target_const boolean"
    rows = [
        ("and of three, false", "and", None, ["a", "b", "c"], [], None, False), ("two of three, false", "atleast", 2, ["a", "b", "c"], [], None, False),
        ("three of three, false", "atleast", 3, ["a", "b", "c"], [], None, False), ("all of the hypothesis", "null", None, ["a"], ["a"], "z", None),
        ("or with a source", "or", None, ["a", "b"], ["a"], "z", None), ("source from elsewhere", "and", None, ["a", "b"], ["q"], "z", None), ("one of two", "and", None, ["a", "b"], ["a"], "z", None),
    ]
    kinds = {r.name: r.kind for r in spark.createDataFrame(rows, schema).select("name", substitutions.kind().alias("kind")).collect()}
    assert kinds == dict(zip((r[0] for r in rows), (None, "delete-terms", None, "recovery-rule", None, None, "exchange-event"), strict=True))


def test_cut_sets(spark):
    args = [("T", "and", "G", True), ("T", "and", "H", True), ("G", "or", "a", False), ("G", "or", "b", False), ("H", "or", "a", False), ("H", "or", "c", False)]
    cuts = quantify.cut_sets(spark.createDataFrame([("T",)], "gate string"), spark.createDataFrame(args, "gate string, connective string, arg string, is_gate boolean"))
    assert {tuple(r.cut) for r in cuts.collect()} == {("a",), ("b", "c")}


def test_externs(spark):
    with pytest.raises(errors.IllegalOperation):
        externs.Registry().add("f", abs, "double", "double")
    r = externs.Registry(allow=True)
    r.add("f", lambda a, b: a * 10 + b, "double", "int", "double")
    assert one(spark, r.call("f", F.lit(2.9), F.lit(0.5)))[0] == 20.5
    with pytest.raises(errors.ValidityError):
        r.add("g", abs, "double", *["int"] * 6)
    with pytest.raises(errors.ValidityError):
        r.call("f", F.lit(1.0))
    with pytest.raises(errors.DLError):
        r.call("h")


def test_elements(spark):
    rows = spark.createDataFrame([("a", "private", ""), ("b.c", "public", ".x"), ("", "public", "y"), ("ok", "private", "t")], "name string, role string, base string")
    got = [(bool(r.n), bool(r.r)) for r in rows.select(elements.bad_name(F.col("name")).alias("n"), elements.bad_role(F.col("role"), F.col("base")).alias("r")).collect()]
    assert got == [(False, True), (True, True), (True, False), (False, False)]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.xml").write_text('<opsa-mef><define-gate name="a.b"/></opsa-mef>')
    (tmp_path / "in/b.xml").write_text("<opsa-mef>")
    q = streaming.name_violations(spark, f"file://{tmp_path}/in").writeStream.format("memory").queryName("found").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.code for r in spark.table("found").collect()} == {"XmlError", "ValidityError"}


def test_common_causes_of_large_groups(spark, tmp_path):
    import duckdb

    from riskweave import catalog

    queries, sql = catalog.queries(), catalog.oracle_sql()

    rows = [(i, 1) for i in range(60)] + [(100 + i, 2) for i in range(13)] + [(200, 3), (201, 3), (300, 4)]
    spark.createDataFrame(rows, "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet/*.parquet'")
    got = {}
    models = ("ccf_beta", "ccf_mgl", "ccf_alpha", "ccf_phi")
    for name in (*models, "ccf_combinations", "ccf_proxy_gates"):
        got[name] = sorted(map(tuple, queries[name](spark, str(tmp_path)).collect()))
        want = sorted(db.execute(sql[name]).fetchall())
        assert [r[:-1] for r in got[name]] == [r[:-1] for r in want]
        assert all(a[-1] == b[-1] or abs(a[-1] - b[-1]) < 1e-11 for a, b in zip(got[name], want, strict=True))
    assert sum(len(got[m]) for m in models) == 3 * 2 + 3 * (60 + 13 + 2)
    assert {int(r[0]) for r in got["ccf_proxy_gates"]} == {i for i, n in rows if n != 4}


def test_minimal_cut_sets_of_orders(spark, tmp_path):
    from riskweave import catalog

    rows = [(1, 10, 2), (1, 11, 3), (1, 10, 5), (1, 12, 4), (2, 7, 3), (2, 8, 5), (3, 1, 2), (3, 2, 1)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = set(map(tuple, catalog.queries()["cutset_minimal"](spark, str(tmp_path)).collect()))
    assert got == {(1, 10, 10), (1, 11, 12), (2, 7, 7), (2, 8, 8), (3, 1, 2)}


def test_gamma_and_beta_over_whole_arrays(spark):
    import pandas as pd

    n = 200_000
    key = [pd.Series(np.full(n, 7)), pd.Series(np.arange(n)), pd.Series(np.full(n, 3))]
    full = lambda x: pd.Series(np.full(n, x))
    for k, theta in ((0.3, 2.0), (1.0, 1.0), (2.5, 0.5), (40.0, 3.0)):
        x = deviates.gamma.func(*key, full(k), full(theta))
        assert x.mean() == pytest.approx(k * theta, rel=0.02) and x.var() == pytest.approx(k * theta**2, rel=0.05)
    for a, b in ((0.4, 0.7), (2.0, 6.0)):
        x = deviates.beta.func(*key, full(a), full(b))
        assert x.mean() == pytest.approx(a / (a + b), rel=0.02) and x.var() == pytest.approx(a * b / ((a + b) ** 2 * (a + b + 1)), rel=0.05)
        assert x.between(0, 1).all()
    # the same key gives the same draw whatever stands beside it; parameters outside the law give null
    some = [k.iloc[100:105].reset_index(drop=True) for k in key]
    assert list(deviates.gamma.func(*some, full(2.5)[:5], full(0.5)[:5])) == list(deviates.gamma.func(*key, full(2.5), full(0.5))[100:105])
    odd = deviates.gamma.func(*[k[:4] for k in key], pd.Series([0.0, -1.0, None, 1.0]), pd.Series([1.0, 1.0, 1.0, 1.0]))
    assert odd.isna().tolist() == [True, True, True, False]
    tiny = deviates.beta.func(*[k[:4] for k in key], full(1e-5)[:4], full(1e-5)[:4])
    assert tiny.notna().all()


def test_externs_of_whole_arrays(spark):
    def f(a, b):
        return a * 10 + b

    f.whole_arrays = True
    r = externs.Registry(allow=True)
    r.add("f", f, "int", "int", "double")
    rows = spark.createDataFrame([(2.9, 0.5), (None, 1.0), (-1.5, 0.25)], "a double, b double").select(r.call("f", F.col("a"), F.col("b")).alias("x")).collect()
    assert sorted(x.x for x in rows if x.x is not None) == [-9.0, 20.0] and len(rows) == 3
