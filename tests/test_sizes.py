"""What goes through the driver, and what loading leaves to be done later."""

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.operators import graphs
from riskweave.plans import exact, model
from riskweave.sources import xml_nodes

FACTOR = "spark.sql.sources.fileCompressionFactor"


def test_files_count_with_their_size_in_memory_while_tables_are_written(spark):
    before, rounds = spark.conf.get(FACTOR), graphs.Rounds(spark)
    names = rounds.save(spark.range(400_000).select(F.concat(F.lit("a name that shrinks in a file "), F.lit(7)).alias("x"), (F.col("id") % 5).alias("k")))
    joined = names.join(spark.range(400_000).select((F.col("id") % 1000).alias("k"), F.lit(1).alias("y")).distinct().repartition(2), "k")
    with graphs.memory_sizes(spark), graphs.memory_sizes(spark):
        assert float(spark.conf.get(FACTOR)) >= graphs.EXPANSION
    assert spark.conf.get(FACTOR) == before
    assert rounds.save(joined).count() == 400_000
    assert spark.conf.get(FACTOR) == before


def test_loading_leaves_tables_and_checks_until_they_are_needed(spark, tmp_path):
    xml = "<opsa-mef><define-fault-tree name='F'><define-gate name='G'><and><basic-event name='A'/><basic-event name='B'/></and></define-gate></define-fault-tree>"
    (tmp_path / "m.xml").write_text(xml + "<model-data><define-basic-event name='A'><float value='0.5'/></define-basic-event></model-data></opsa-mef>")
    m = model.load(spark, [str(tmp_path / "m.xml")])
    for table in ("violations", "gates", "gate_args", "expressions", "top_events"):
        assert not isinstance(m.tables[table], DataFrame)
    assert [r.arg_id for r in m.gate_args.orderBy("ordinal").collect()] == ["A", None]
    assert not isinstance(m.tables["violations"], DataFrame)
    assert [(r.code, r.entity) for r in m.violations.collect()] == [("UndefinedElement", "B")]


def test_tree_nodes_leave_out_gates_but_not_definitions_at_odd_places(spark, tmp_path):
    gate = "<define-gate name='{}'><not><constant value='true'/></not></define-gate>"
    xml = f"<opsa-mef><define-fault-tree name='F'>{gate.format('G')}</define-fault-tree><define-sequence name='S'>{gate.format('H')}</define-sequence></opsa-mef>"
    (tmp_path / "m.xml").write_text(xml)
    m = model.load(spark, [str(tmp_path / "m.xml")])
    assert {(r.tag, r.attrs.get("name")) for r in m.tree_nodes.where("tag LIKE 'define-gate'").collect()} == {("define-gate", "H")}
    assert ("ValidityError", "unknown instruction") in {(r.code, r.detail) for r in m.violations.collect()}


def test_only_roots_that_may_share_are_looked_into(spark):
    rows = {"a": [("x", 0), ("y", 1)], "b": [("x", 0), ("c", 1)], "c": [("x", 0), ("y", 1)], "d": [("e", 0), ("z", 1)], "e": [("x", 0), ("y", 1)], "f": [("x", 0), ("__true__", 1), ("__true__", 2)]}
    gates = spark.createDataFrame([(g, "and", None, None) for g in rows], "id string, connective string, min_num int, max_num int")
    args = spark.createDataFrame([(g, i, a, False) for g, xs in rows.items() for a, i in xs], "gate_id string, ordinal int, arg_id string, complement boolean")
    g = exact.Graph(gates, args, spark.createDataFrame([(e, 0.5) for e in "xyz"], "id string, p double"))
    rounds = graphs.Rounds(spark)
    found = exact.cores(g.saved(rounds), gates.select("id"), rounds)
    assert {r.root for r in found.reached.collect()} == {"b"}
    assert {r.id: r.p for r in exact.probabilities(g, gates.select("id")).collect()} == {"a": 0.25, "b": 0.25, "c": 0.25, "d": 0.125, "e": 0.25, "f": 0.5}


def test_gates_over_very_many_nodes_are_looked_into(spark):
    n = exact.MOST_BELOW + 1
    gates = spark.createDataFrame([("g", "or", None, None)], "id string, connective string, min_num int, max_num int")
    args = spark.createDataFrame([("g", i, f"e{i}", False) for i in range(n)], "gate_id string, ordinal int, arg_id string, complement boolean")
    g = exact.Graph(gates, args, spark.createDataFrame([(f"e{i}", 0.01) for i in range(n)], "id string, p double"))
    assert abs(exact.probabilities(g, gates.select("id")).first().p - (1 - 0.99**n)) < 1e-12


def test_files_of_nodes_are_written_without_sorting_by_section(spark):
    before = spark.conf.get(graphs._WRITERS)
    with graphs.memory_sizes(spark):
        assert int(spark.conf.get(graphs._WRITERS)) > len(xml_nodes.SECTIONS) + 1
    assert spark.conf.get(graphs._WRITERS) == before


def test_columns_of_nodes_and_inclusions_with_odd_names(spark, tmp_path):
    (tmp_path / "in é.xml").write_text("<define-basic-event name='B'><label>text &amp; more</label><float value='0.5'/></define-basic-event>")
    (tmp_path / "m.xml").write_text("<opsa-mef><model-data><xi:include xmlns:xi='x'\n href='in é.xml'/><define-basic-event name='A' role='public'/></model-data></opsa-mef>")
    assert list(xml_nodes._included(spark, [f"file:{tmp_path}/m.xml"])) == [f"file:{tmp_path}/in é.xml"]
    batch = xml_nodes.parse("f", (tmp_path / "m.xml").read_bytes(), {"in é.xml": (tmp_path / "in é.xml").read_bytes()})
    rows = batch.to_pylist()
    assert [(r["tag"], r["parent"], r["ordinal"], r["place"], r["section"]) for r in rows] == [
        ("opsa-mef", None, 0, 0, "other"), ("model-data", 0, 0, 0, "other"), ("define-basic-event", 1, 0, 0, "define-basic-event"), ("label", 2, 0, 0, "described"),
        ("float", 2, 1, 0, "define-basic-event"), ("define-basic-event", 1, 1, 1, "define-basic-event"),
    ]
    assert [dict(r["attrs"]) for r in rows[2:]] == [{"name": "B"}, {}, {"value": "0.5"}, {"name": "A", "role": "public"}]
    assert rows[3]["text"] == "text & more" and rows[4]["def_name"] == "B" and rows[4]["up"] == "define-basic-event" and rows[4]["places"] == []
    wrong = xml_nodes.parse("f", b"<a><b></a>", {}).to_pylist()
    assert len(wrong) == 1 and wrong[0]["tag"] == "#error" and dict(wrong[0]["attrs"]) == {"kind": "parse"} and wrong[0]["text"].startswith("ParseError: mismatched tag")


def test_shuffle_files_go_when_a_table_is_written(spark):
    held = lambda: [n for n in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").split() if "/shuffle_" in n]
    before, rounds = set(held()), graphs.Rounds(spark)
    assert not graphs.empty(rounds.save(spark.range(100_000).groupBy((F.col("id") % 1000).alias("k")).count().repartition(3, "count")))
    for _ in range(50):
        if not (left := set(held()) - before):
            break
        time.sleep(0.2)
    assert not left


def test_small_tables_meet_large_ones_without_dealing_these_out(spark):
    rounds = graphs.Rounds(spark)
    large = rounds.save(spark.range(300_000).select(F.col("id").cast("string").alias("gate_id"), F.lit("a gate").alias("x")))
    few = spark.createDataFrame([("7",), ("7",), ("9",), ("no",)], "gate_id string")
    found = graphs.only(large, few, "gate_id")
    assert sorted(r.gate_id for r in found.collect()) == ["7", "9"]
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_slopes_come_with_probabilities(spark):
    gates = spark.createDataFrame([("g", "or", None, None), ("h", "and", None, None)], "id string, connective string, min_num int, max_num int")
    args = spark.createDataFrame([("g", 0, "h", True), ("g", 1, "c", False), ("h", 0, "a", False), ("h", 1, "b", False), ("h", 2, "__true__", False)], "gate_id string, ordinal int, arg_id string, complement boolean")
    g = exact.Graph(gates, args, spark.createDataFrame([("a", 0.25), ("b", 0.5), ("c", 0.5)], "id string, p double"))
    found = {r.id: [tuple(x) for x in r.slopes] for r in exact.independent(g, slopes=True).where("kind = 2").collect()}
    assert found == {"h": [("a", 0.5, exact.EVENT, 0.25), ("b", 0.25, exact.EVENT, 0.5), ("__true__", 0.125, exact.FIXED, 1.0)], "g": [("h", -0.5, exact.GATE, 0.125), ("c", 0.125, exact.EVENT, 0.5)]}
