"""Walks with the context, the house events and the formulas of each way."""

import pytest

from riskweave.plans import trees
from tests.test_model import load

PATHS = """<opsa-mef>
  <define-sequence name="S"><if><test-functional-event name="A" state="no"/><collect-expression><float value="0.25"/></collect-expression><collect-expression><float value="0.5"/></collect-expression></if></define-sequence>
  <define-event-tree name="T"><define-functional-event name="A"/><initial-state><fork functional-event="A">
    <path state="yes"><collect-expression><float value="0.9"/></collect-expression><sequence name="S"/></path>
    <path state="no"><collect-expression><float value="0.1"/></collect-expression><sequence name="S"/></path></fork></initial-state></define-event-tree>
  <define-initiating-event name="I" event-tree="T"/></opsa-mef>"""

HOUSE = """<opsa-mef>
  <define-fault-tree name="F"><define-house-event name="H"><constant value="false"/></define-house-event>
    <define-gate name="g"><and><house-event name="H"/><basic-event name="B"/></and></define-gate>
    <define-gate name="k"><or><gate name="g"/><basic-event name="C"/></or></define-gate>
    <define-basic-event name="B"><float value="0.5"/></define-basic-event><define-basic-event name="C"><float value="0.2"/></define-basic-event></define-fault-tree>
  <define-sequence name="S"><collect-formula><gate name="F.g"/></collect-formula></define-sequence>
  <define-sequence name="both"><collect-formula><gate name="F.k"/></collect-formula></define-sequence>
  <define-event-tree name="T"><define-functional-event name="A"/><initial-state><fork functional-event="A">
    <path state="on"><set-house-event name="H"><constant value="true"/></set-house-event><sequence name="S"/></path>
    <path state="twice"><set-house-event name="H"><constant value="true"/></set-house-event><collect-formula><gate name="F.k"/></collect-formula><set-house-event name="H"><constant value="false"/></set-house-event><sequence name="both"/></path>
    <path state="off"><sequence name="S"/></path>
    <path state="not"><collect-formula><not><gate name="F.k"/></not></collect-formula><sequence name="both"/></path></fork></initial-state></define-event-tree>
  <define-initiating-event name="I" event-tree="T"/></opsa-mef>"""

NESTED = """<opsa-mef>
  <define-parameter name="half"><ite><test-initiating-event name="J"/><float value="0.5"/><float value="0.25"/></ite></define-parameter>
  <define-rule name="R"><if><or><test-functional-event name="A" state="y"/><test-functional-event name="B" state="y"/></or>
    <block><if><test-functional-event name="B" state="y"/><collect-expression><parameter name="half"/></collect-expression><rule name="low"/></if></block></if></define-rule>
  <define-rule name="low"><collect-expression><float value="0.125"/></collect-expression></define-rule>
  <define-sequence name="on"><rule name="R"/><event-tree name="U"/></define-sequence>
  <define-sequence name="end"><if><and><test-functional-event name="A" state="y"/><test-functional-event name="Z" state="z"/></and><collect-expression><float value="0.1"/></collect-expression></if></define-sequence>
  <define-event-tree name="T"><define-functional-event name="A"/><define-functional-event name="B"/>
    <define-branch name="b"><fork functional-event="B"><path state="y"><sequence name="on"/></path><path state="n"><sequence name="on"/></path></fork></define-branch>
    <initial-state><fork functional-event="A"><path state="y"><branch name="b"/></path><path state="n"><branch name="b"/></path></fork></initial-state></define-event-tree>
  <define-event-tree name="U"><define-functional-event name="Z"/><initial-state><fork functional-event="Z"><path state="z"><sequence name="end"/></path><path state="x"><sequence name="end"/></path></fork></initial-state></define-event-tree>
  <define-initiating-event name="I" event-tree="T"/><define-initiating-event name="J" event-tree="T"/></opsa-mef>"""


def walked(m):
    assert m.violations.collect() == []
    return {(r.ie, r.sequence, *sorted(r.context.items())): r.p for r in trees.walk(m).collect()}


def test_conditions_follow_the_way(spark, tmp_path):
    got = walked(load(spark, tmp_path, PATHS))
    assert got == {("I", "S", ("A", "yes")): pytest.approx(0.45), ("I", "S", ("A", "no")): pytest.approx(0.025)}


def test_formulas_with_house_events(spark, tmp_path):
    got = walked(load(spark, tmp_path, HOUSE))
    # twice: k with H and k without H both hold: C alone, as k without H is C; not: k and its complement never hold together
    assert got == {
        ("I", "S", ("A", "on")): pytest.approx(0.5), ("I", "both", ("A", "twice")): pytest.approx(0.2), ("I", "S", ("A", "off")): pytest.approx(0.0), ("I", "both", ("A", "not")): pytest.approx(0.0),
    }


def test_nested_rules_and_links(spark, tmp_path):
    got = walked(load(spark, tmp_path, NESTED))
    want = {}
    for ie in "IJ":
        for a in "yn":
            for b in "yn":
                for z in "zx":
                    p = (0.5 if ie == "J" else 0.25) if b == "y" else 0.125 if a == "y" else 1.0
                    want[(ie, "end", ("A", a), ("B", b), ("Z", z))] = pytest.approx(p * (0.1 if a == "y" and z == "z" else 1))
    assert got == want
