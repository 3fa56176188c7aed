"""Event trees, common causes, substitutions and external functions from model files."""

import pytest
from pyspark.sql import functions as F

from riskweave.errors import ValidityError
from riskweave.operators import ccf, graphs, substitutions
from riskweave.plans import evaluate, model, trees
from riskweave.settings import Settings
from tests.test_model import load

MODEL = """<opsa-mef>
  <define-extern-library name="lib" path="lib.so"/>
  <define-extern-function name="twice" symbol="twice_" library="lib"><double/><double/></define-extern-function>
  <define-rule name="R"><set-house-event name="H"><constant value="true"/></set-house-event><collect-expression><float value="0.5"/></collect-expression></define-rule>
  <define-sequence name="end"><rule name="R"/></define-sequence>
  <define-sequence name="more"><event-tree name="U"/></define-sequence>
  <define-sequence name="done"><collect-expression><float value="0.25"/></collect-expression></define-sequence>
  <define-event-tree name="T"><define-functional-event name="A"/><define-functional-event name="B"/>
    <define-branch name="late"><fork functional-event="B"><path state="y"><sequence name="end"/></path><path state="n"><sequence name="more"/></path></fork></define-branch>
    <initial-state><collect-expression><float value="0.1"/></collect-expression><fork functional-event="A"><path state="y"><branch name="late"/></path>
      <path state="n"><if><test-functional-event name="A" state="n"/><collect-expression><float value="0.2"/></collect-expression></if><sequence name="end"/></path></fork></initial-state></define-event-tree>
  <define-event-tree name="U"><initial-state><sequence name="done"/></initial-state></define-event-tree>
  <define-initiating-event name="I" event-tree="T"/>
  <define-fault-tree name="F">
    <define-house-event name="H"><constant value="false"/></define-house-event>
    <define-gate name="G"><and><basic-event name="X"/><basic-event name="m1"/></and></define-gate>
    <define-basic-event name="X"><label>an event</label><attributes><attribute name="k" value="v"/></attributes><extern-function name="twice"><float value="0.25"/></extern-function></define-basic-event>
    <define-CCF-group name="c" model="beta-factor"><members><basic-event name="m1"/><basic-event name="m2"/></members>
      <distribution><float value="0.1"/></distribution><factor><float value="0.2"/></factor></define-CCF-group>
    <define-CCF-group name="f" model="phi-factor"><members><basic-event name="n1"/><basic-event name="n2"/></members>
      <distribution><float value="0.1"/></distribution><factors><factor><float value="0.7"/></factor><factor><float value="0.3"/></factor></factors></define-CCF-group>
  </define-fault-tree>
</opsa-mef>"""


def test_sound(spark, tmp_path):
    m = load(spark, tmp_path, MODEL, allow_extern=True, functions={"twice_": lambda x: 2 * x}, check_values=True, settings=Settings(probability_analysis=True))
    assert m.violations.collect() == []
    ways = {(r.sequence, tuple(sorted(r.context.items()))): r.p for r in trees.walk(m).collect()}
    assert ways == {
        ("end", (("A", "y"), ("B", "y"))): pytest.approx(0.05), ("done", (("A", "y"), ("B", "n"))): pytest.approx(0.025), ("end", (("A", "n"),)): pytest.approx(0.01),
    }
    p = {r.id: r.p for r in evaluate.gate_probabilities(m).collect()}
    member = 1 - (1 - 0.08) * (1 - 0.02)
    assert p["X"] == 0.5 and p["m1"] == pytest.approx(member) and p["G"] == pytest.approx(0.5 * member)
    assert {r.id for r in m.ccf_events.collect()} == {"[m1]", "[m2]", "[m1 m2]", "[n1]", "[n2]", "[n1 n2]"}
    assert p["n1"] == pytest.approx(1 - (1 - 0.07) * (1 - 0.03))
    mc = {r.id: r.p for r in evaluate.simulate(m, trials=2000, seed=1).collect()}
    assert mc["G"] == pytest.approx(0.5 * member, abs=0.02)
    assert [(r.label) for r in m.labels.collect()] == ["an event"] and [(r.name, r.value) for r in m.attributes.collect()] == [("k", "v")]


def test_missing_probability(spark, tmp_path):
    m = load(spark, tmp_path, '<define-gate name="g"><and><basic-event name="A"/><basic-event name="B"/></and></define-gate><define-basic-event name="A"><float value="0.5"/></define-basic-event><define-basic-event name="B"/>')
    assert {r.id: r.p for r in evaluate.gate_probabilities(m).collect()}["g"] is None
    assert [r.p for r in evaluate.simulate(m, trials=10).collect() if r.id == "g"] == [None]


#: Each with the detail of its violation.
WRONG = """<opsa-mef>
  <define-rule name="a"><rule name="b"/></define-rule><define-rule name="b"><block><rule name="a"/></block></define-rule>
  <define-rule name="jump"><event-tree name="L"/></define-rule>
  <define-sequence name="s"><event-tree name="T"/></define-sequence><define-sequence name="s"><mystery/></define-sequence>
  <define-event-tree name="T"><define-functional-event name="A"/><define-functional-event name="B"/>
    <define-branch name="x"><fork functional-event="A"><path state="y"><sequence name="s"/></path></fork></define-branch>
    <initial-state><fork functional-event="B"><path state="y"><branch name="x"/></path><path state="n"><sequence name="nowhere"/></path></fork></initial-state></define-event-tree>
  <define-event-tree name="L"><initial-state><rule name="jump"/><collect-expression><float value="1"/></collect-expression><collect-formula><basic-event name="E"/></collect-formula><set-house-event name="none"><constant value="true"/></set-house-event><branch name="lost"/></initial-state></define-event-tree>
  <define-fault-tree name="F"><define-basic-event name="E"><sqrt><float value="-1"/></sqrt></define-basic-event><define-basic-event name="D"><div><float value="1"/><float value="0"/></div></define-basic-event>
    <define-basic-event name="W"><exponential><float value="1"/></exponential></define-basic-event><define-basic-event name="V"><uniform-deviate><float value="0.5"/><float value="0.1"/></uniform-deviate></define-basic-event>
    <define-basic-event name="P7"><periodic-test><float value="0.001"/><float value="0.001"/><float value="0.001"/><float value="0.001"/><float value="0.001"/><float value="0.001"/><float value="0.001"/></periodic-test></define-basic-event>
    <define-basic-event name="P11"><periodic-test><float value="0.001"/><float value="0.001"/><float value="0.05"/><float value="100"/><float value="50"/><float value="2"/><float value="10"/><float value="1"/><float value="0.9"/><float value="0.03"/><float value="295"/></periodic-test></define-basic-event>
    <define-CCF-group name="c" model="phi-factor"><members><basic-event name="m1"/><basic-event name="m2"/></members><distribution><float value="2"/></distribution><factor level="1"><float value="0.5"/></factor></define-CCF-group>
    <define-CCF-group name="d" model="MGL"><members><basic-event name="o1"/><basic-event name="o2"/></members><distribution><float value="0.1"/></distribution><factor level="3"><float value="0.5"/></factor></define-CCF-group>
    <define-CCF-group name="e" model="alpha-factor"><members><basic-event name="q1"/><basic-event name="q2"/></members></define-CCF-group></define-fault-tree>
  <define-substitution name="u"><hypothesis><and><basic-event name="E"/><basic-event name="m1"/></and></hypothesis><source><basic-event name="E"/><basic-event name="E"/></source><target><basic-event name="D"/></target></define-substitution>
  <define-substitution name="w"><hypothesis><or><basic-event name="E"/><not><basic-event name="D"/></not></or></hypothesis><target><constant value="false"/></target></define-substitution>
  <define-alignment name="al"><define-phase name="p" time-fraction="1"><set-house-event name="none"><constant value="true"/></set-house-event></define-phase></define-alignment>
</opsa-mef>"""


def test_wrong(spark, tmp_path):
    found = load(spark, tmp_path, WRONG, check_values=True).violations.collect()
    got = {(r.code, r.detail.split(":")[0].split(" after ")[0], r.entity) for r in found}
    assert got >= {
        ("CycleError", "cycle among rules", "a->b->a"), ("CycleError", "cycle among event-tree links", "T->T"), ("ValidityError", "links belong into sequences", "L"),
        ("DuplicateElementError", "sequence defined more than once", "s"), ("ValidityError", "unknown instruction", "mystery"), ("ValidityError", "functional event out of order", "T.A"),
        ("UndefinedElement", "sequence of a branch", "nowhere"), ("UndefinedElement", "branch of a branch", "lost"), ("ValidityError", "collects both expressions and formulas", "L"),
        ("UndefinedElement", "house event of an instruction", "none"), ("UndefinedElement", "house event of a phase", "none"), ("DomainError", "argument outside the operator's domain", "sqrt"),
        ("DomainError", "division by zero", "div"), ("ValidityError", "wrong number of arguments", "exponential"), ("ValidityError", "wrong number of arguments", "periodic-test"), ("DomainError", "argument outside the law's domain", "periodic-test"), ("ValidityError", "minimum not below maximum", "uniform-deviate"),
        ("DomainError", "distribution or factor is not a probability", "group:c"), ("ValidityError", "factors of a phi model must sum to 1", "c"), ("ValidityError", "level out of range", "d"),
        ("LogicError", "a group needs a distribution and factors", "e"), ("DuplicateElementError", "source given twice", "u"), ("ValidityError", "hypothesis with complements", "w"),
        ("ValidityError", "events of a non-declarative substitution in a common-cause group", "u"), ("ValidityError", "non-declarative substitutions need an approximation", "u"),
    }


def test_kinds_of_substitutions(spark):
    rows = [
        ("and of three to false", "and", None, ["a", "b", "c"], [], None, False, None), ("and of two to false", "and", None, ["a", "b"], [], None, False, "delete-terms"),
        ("two of three to false", "atleast", 2, ["a", "b", "c"], [], None, False, "delete-terms"), ("three to false", "atleast", 3, ["a", "b", "c", "d"], [], None, False, None),
        ("and", "and", None, ["a", "b", "c"], [], "x", None, "recovery-rule"), ("or", "or", None, ["a", "b"], [], "x", None, None),
        ("null with itself", "null", None, ["a"], ["a"], "x", None, "recovery-rule"), ("or with a source", "or", None, ["a", "b"], ["a"], "x", None, None),
        ("all sources", "and", None, ["a", "b"], ["b", "a"], "x", None, "recovery-rule"), ("as many others", "and", None, ["a", "b"], ["a", "c"], "x", None, None),
        ("one", "and", None, ["a", "b"], ["a"], "x", None, "exchange-event"), ("one outside", "and", None, ["a", "b"], ["c"], "x", None, None), ("to true", "and", None, ["a", "b"], ["a"], None, True, None),
    ]
    subs = spark.createDataFrame(rows, "name string, connective string, min_num int, hypothesis array<string>, source array<string>, target_event string, target_const boolean, want string")
    assert [r.name for r in subs.withColumn("kind", substitutions.kind()).where("NOT kind <=> want").collect()] == []


def test_cycles_and_combinations(spark):
    ring = [(f"n{i:03}", f"n{(i + 1) % 150:03}") for i in range(150)] + [("n000", "leaf"), ("root", "n005"), ("s", "s")]
    paths = [r.path for r in graphs.some_cycles(spark.createDataFrame(ring, "a string, b string")).collect()]
    assert sorted(map(len, (p.split("->") for p in paths))) == [2, 151]
    members = spark.createDataFrame([("g", i, f"m{i:02}") for i in range(30)], "group_id string, ordinal int, event_id string")
    levels = spark.createDataFrame([("g", 1), ("g", 2), ("g", 29), ("g", 30)], "group_id string, level int")
    got = ccf.combinations(members, levels).groupBy("level").agg(F.countDistinct("members").alias("n"), F.min(F.size("members")).alias("size")).collect()
    assert {(r.level, r.n, r["size"]) for r in got} == {(1, 30, 1), (2, 435, 2), (29, 30, 29), (30, 1, 30)}


def test_settings_stay(spark):
    s = Settings(importance_analysis=True)
    s.probability_analysis = False
    assert s.probability_analysis
    with pytest.raises(ValidityError):
        from riskweave.operators.externs import Signature

        Signature("double", ("int",) * 6)
