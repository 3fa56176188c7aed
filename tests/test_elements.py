"""Attributes of containers, contents of components, gates of members, changes of formulas."""

from pyspark.sql import functions as F

from riskweave.operators import elements, formulas
from riskweave.plans import evaluate, model
from tests.test_model import load

NESTED = """<define-fault-tree name="F"><attributes><attribute name="site" value="a"/><attribute name="kind" value="tree"/></attributes>
  <define-component name="C"><attributes><attribute name="kind" value="part"/></attributes>
    <define-basic-event name="E"><attributes><attribute name="own" value="1"/></attributes><float value="0.1"/></define-basic-event>
    <define-CCF-group name="g" model="beta-factor"><members><basic-event name="m1"/><basic-event name="m2"/></members><distribution><float value="0.1"/></distribution><factor><float value="0.2"/></factor></define-CCF-group>
  </define-component></define-fault-tree>"""


def test_containers(spark, tmp_path):
    m = load(spark, tmp_path, f"<opsa-mef>{NESTED}</opsa-mef>")
    assert m.violations.collect() == []
    names = {(r.file, r.node): r.name for r in m.nodes.where("tag LIKE 'define-%'").select("file", "node", F.col("attrs")["name"].alias("name")).collect()}
    got = {(names[r.file, r.node], r.name): r.value for r in model.inherited_attributes(m).collect()}
    assert got == {("F", "site"): "a", ("F", "kind"): "tree", ("C", "site"): "a", ("C", "kind"): "part", ("E", "site"): "a", ("E", "kind"): "part", ("E", "own"): "1", ("g", "site"): "a", ("g", "kind"): "part"}
    assert {(r.path, r.kind, r.id) for r in model.component_contents(m).collect()} == {("F.C", "basic-event", "E"), ("F.C", "basic-event", "m1"), ("F.C", "basic-event", "m2"), ("F.C", "CCF-group", "g")}
    assert {r.event_id: r.args for r in evaluate.ccf_gates(m).collect()} == {"m1": ["[m1 m2]", "[m1]"], "m2": ["[m1 m2]", "[m2]"]}


def test_formulas_changed(spark):
    gates = spark.createDataFrame([("g", "and"), ("h", "or")], "id string, connective string")
    args = spark.createDataFrame([("g", 0, "a"), ("g", 1, "b"), ("g", 2, "c"), ("h", 0, "a")], "gate_id string, ordinal int, arg_id string")
    left = formulas.remove_args(args, spark.createDataFrame([("g", "a"), ("x", "b")], "gate_id string, arg_id string"))
    assert {(r.gate_id, r.ordinal, r.arg_id) for r in left.collect()} == {("g", 0, "b"), ("g", 1, "c"), ("h", 0, "a")}
    new_gates = spark.createDataFrame([("h", "xor"), ("none", "or")], "id string, connective string")
    new_args = spark.createDataFrame([("h", 0, "b"), ("h", 1, "c"), ("none", 0, "a")], "gate_id string, ordinal int, arg_id string")
    got = [sorted(map(tuple, d.collect())) for d in formulas.replace_formulas(gates, args, new_gates, new_args)]
    assert got[0] == [("g", "and"), ("h", "xor")] and [r for r in got[1] if r[0] != "g"] == [("h", 0, "b"), ("h", 1, "c")] and got[2] == [("h", "or")] and got[3] == [("h", 0, "a")]
    rows = spark.createDataFrame([([1, 2], [2, 3]), ([1], [2]), ([], [1]), (None, [1]), ([None, 1], [None])], "a array<int>, b array<int>")
    assert [r[0] for r in rows.select(elements.intersects(F.col("a"), F.col("b"))).collect()] == [True, False, False, False, False]
