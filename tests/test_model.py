"""Model files end to end: one valid model, one broken one for each rule."""

import pytest
from pyspark.sql import functions as F

from riskweave.errors import BY_CODE, CycleError, IllegalOperation, IOError_, XmlError
from riskweave.plans import evaluate, model
from riskweave.settings import Settings
from riskweave.sources import xml_nodes

VALID = """<opsa-mef name="demo">
  <define-fault-tree name="FT">
    <define-gate name="TOP"><or><gate name="G1"/><not><basic-event name="C"/></not></or></define-gate>
    <define-gate name="G1"><and><basic-event name="A"/><basic-event name="B"/></and></define-gate>
    <define-basic-event name="A"><float value="0.1"/></define-basic-event>
    <define-basic-event name="B"><mul><parameter name="q"/><float value="2"/></mul></define-basic-event>
    <define-basic-event name="C"><float value="0.9"/></define-basic-event>
    <define-parameter name="q"><float value="0.1"/></define-parameter>
  </define-fault-tree>
</opsa-mef>"""


def load(spark, tmp_path, *bodies, **how):
    files = []
    for i, body in enumerate(bodies):
        p = tmp_path / f"m{i}.xml"
        p.write_text(body if body.startswith("<opsa-mef") else f'<opsa-mef><define-fault-tree name="T">{body}</define-fault-tree></opsa-mef>')
        files.append(f"file://{p}")
    return model.load(spark, files, **how)


def test_valid(spark, tmp_path):
    m = load(spark, tmp_path, VALID)
    assert m.name == "demo"
    assert m.violations.collect() == []
    assert [r.gate_id for r in m.top_events.collect()] == ["TOP"]
    p = {r.id: r.p for r in evaluate.gate_probabilities(m).collect()}
    assert p["G1"] == pytest.approx(0.02) and p["TOP"] == pytest.approx(1 - 0.98 * 0.9)
    mc = {r.id: r.p for r in evaluate.simulate(m, trials=4000, seed=3).collect()}
    assert mc["TOP"] == pytest.approx(0.118, abs=0.02)


BROKEN = [
    ('<define-gate name="a.b"><and><event name="X"/><event name="Y"/></and></define-gate>', "ValidityError"),
    ('<define-gate name="g"><and><event name="X"/></and></define-gate><define-basic-event name="X"/>', "ValidityError"),
    ('<define-gate name="g"><or><event name="X"/><event name="Z"/></or></define-gate><define-basic-event name="X"/>', "UndefinedElement"),
    ('<define-gate name="g"><or><event name="X"/><event name="X"/></or></define-gate><define-basic-event name="X"/>', "DuplicateElementError"),
    ('<define-gate name="X"><null><event name="X"/></null></define-gate><define-basic-event name="X"/>', "DuplicateElementError"),
    ('<define-gate name="g"><or><and><event name="X"/></and><event name="X"/></or></define-gate><define-basic-event name="X"/>', "ValidityError"),
    ('<define-gate name="g"><not><constant value="true"/></not></define-gate>', "LogicError"),
    ('<define-gate name="a"><null><gate name="b"/></null></define-gate><define-gate name="b"><null><gate name="a"/></null></define-gate>', "CycleError"),
    ('<define-parameter name="x"><parameter name="y"/></define-parameter><define-parameter name="y"><parameter name="x"/></define-parameter>', "CycleError"),
    ('<define-basic-event name="X"><parameter name="p" unit="hours"/></define-basic-event><define-parameter name="p" unit="years"><float value="1"/></define-parameter>', "ValidityError"),
    ('<define-basic-event name="X"><float value="0.1x"/></define-basic-event>', "ValidityError"),
    ('<define-CCF-group name="c" model="MGL"><members><basic-event name="A"/></members></define-CCF-group>', "ValidityError"),
    ('<opsa-mef><define-event-tree name="E"><define-functional-event name="F"/><initial-state><fork functional-event="F"><path state="s"/><path state="s"/></fork></initial-state></define-event-tree></opsa-mef>', "ValidityError"),
    ('<opsa-mef><define-alignment name="L"><define-phase name="p" time-fraction="0.5"/></define-alignment></opsa-mef>', "ValidityError"),
    ('<opsa-mef><define-fault-tree name="T"></opsa-mef>', "XmlError"),
]


@pytest.mark.parametrize(("body", "code"), BROKEN)
def test_broken(spark, tmp_path, body, code):
    m = load(spark, tmp_path, body)
    assert code in {r.code for r in m.violations.collect()}


def test_strict_and_files(spark, tmp_path):
    with pytest.raises(CycleError):
        load(spark, tmp_path, BROKEN[7][0], strict=True)
    with pytest.raises(IOError_):
        model.load(spark, [f"file://{tmp_path}/none*.xml"])
    with pytest.raises(IOError_):
        model.load(spark, [f"file://{tmp_path}/m0.xml"] * 2)
    with pytest.raises(IllegalOperation):
        load(spark, tmp_path, '<opsa-mef><define-extern-library name="l" path="x"/></opsa-mef>')
    assert BY_CODE["IOError"] is IOError_


def test_expressions(spark, tmp_path):
    body = """<define-basic-event name="S"><switch><case><lt><float value="2"/><float value="1"/></lt><float value="0.5"/></case><float value="0.25"/></switch></define-basic-event>
    <define-basic-event name="E"><exponential><float value="1e-4"/><system-mission-time/></exponential></define-basic-event>
    <define-basic-event name="U"><uniform-deviate><float value="0.1"/><float value="0.3"/></uniform-deviate></define-basic-event>
    <define-basic-event name="H"><histogram><float value="0"/><bin><float value="0.5"/><float value="1"/></bin><bin><float value="1"/><float value="3"/></bin></histogram></define-basic-event>
    <define-basic-event name="N"><sub><float value="1"/><float value="0.25"/><float value="0.5"/></sub></define-basic-event>"""
    m = load(spark, tmp_path, body)
    p = {r.id: r for r in evaluate.event_probabilities(m).collect()}
    assert p["S"].p == 0.25 and p["N"].p == 0.25
    assert p["E"].p == pytest.approx(0.58355463398)
    assert (p["U"].p, p["U"].lo, p["U"].hi, p["U"].deviate) == (pytest.approx(0.2), 0.1, 0.3, True)
    assert p["H"].p == pytest.approx((0.25 * 1 + 0.75 * 3) / 4)
    draws = evaluate.event_probabilities(m, trials=300, seed=1).where("id IN ('U', 'H')").groupBy("id").agg(F.avg("p").alias("m"), F.min("p").alias("lo"), F.max("p").alias("hi")).collect()
    got = {r.id: r for r in draws}
    assert got["U"].m == pytest.approx(0.2, abs=0.02) and 0.1 <= got["U"].lo and got["U"].hi <= 0.3
    assert got["H"].m == pytest.approx(0.625, abs=0.06)


def test_include_and_settings(spark, tmp_path):
    (tmp_path / "part.xml").write_text('<define-basic-event name="A"><float value="0.1"/></define-basic-event>')
    m = load(spark, tmp_path, '<opsa-mef xmlns:xi="http://www.w3.org/2001/XInclude"><define-fault-tree name="T"><xi:include href="part.xml"/></define-fault-tree></opsa-mef>')
    assert [r.id for r in m.basic_events.collect()] == ["A"]
    s = Settings(algorithm="mocus")
    assert s.approximation == "rare-event"
    with pytest.raises(Exception, match="limit_order"):
        s.limit_order = -1
    s.importance_analysis = True
    assert s.probability_analysis


def test_kinds_of_xml_errors(spark, tmp_path):
    gate = '<define-gate name="g"><null><basic-event name="a"/></null></define-gate><define-basic-event name="a"><float value="0.1"/></define-basic-event>'
    for body, kind in (("<opsa-mef><define-fault-tree>", "parse"), ('<opsa-mef xmlns:xi="http://www.w3.org/2001/XInclude"><xi:include href="nowhere.xml"/></opsa-mef>', "xinclude")):
        with pytest.raises(XmlError) as e:
            load(spark, tmp_path, body, strict=True)
        assert e.value.kind == kind and e.value.keyword in str(e.value)
    with pytest.raises(XmlError) as e:
        load(spark, tmp_path, gate, validator="rules.rng")
    assert e.value.kind == "logic"
    with pytest.raises(XmlError) as e:
        load(spark, tmp_path, gate, validator=lambda nodes: False)
    assert e.value.kind == "validity"
    with pytest.raises(XmlError) as e:
        load(spark, tmp_path, gate, validator=lambda nodes: nodes.select("file"))
    assert e.value.kind == "logic"

    def no_null_gates(nodes):
        return nodes.where("tag = 'null'").select("file", "line", F.lit("null gates are not wanted").alias("detail"))

    found = [r for r in load(spark, tmp_path, gate, validator=no_null_gates).violations.collect() if r.code == "XmlError"]
    assert len(found) == 1 and found[0].detail == "ValidityError: null gates are not wanted" and found[0].line == 1
    assert xml_nodes.read_problem(RuntimeError("[FAILED_READ_FILE.FILE_NOT_EXIST] gone")).kind == "io" and xml_nodes.read_problem(RuntimeError("other")) is None


def test_members_without_combinations(spark, tmp_path):
    """Members' probabilities come from the numbers of their groups' events; these are not made by loading."""
    group = "<define-CCF-group name='c' model='MGL'><members>%s</members><distribution><float value='0.1'/></distribution><factor><float value='0.2'/></factor><factor><float value='0.5'/></factor></define-CCF-group>"
    m = load(spark, tmp_path, group % "".join(f"<basic-event name='m{i}'/>" for i in range(5)) + "<define-gate name='g'><and><basic-event name='m0'/><not><basic-event name='m1'/></not></and></define-gate>")
    got = {r.id: r.p for r in evaluate.gate_probabilities(m, combined=False).collect()}
    assert "ccf_events" not in m.tables
    want = {r.id: r.p for r in evaluate.gate_probabilities(m).collect()}
    assert set(got) == {k for k in want if not k.startswith("[")} and got["g"] == pytest.approx(want["g"]) and got["m0"] == pytest.approx(want["m0"])
