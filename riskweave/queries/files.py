"""Model files end to end over the driver's tables: rendered to XML, loaded, evaluated, and compared with SQL over the tables.

Parts are basic events, orders gates and substitutions, the suppliers of a nation a common-cause group, suppliers and
nations event trees with rules and links; customers make a second model with defects to find.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import graphs
from ..plans import evaluate, model, trees
from ..settings import Settings
from . import query, read

_loaded: dict = {}


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


#: Elements of a kind in one model file.
FILE_ROWS = 8000


def _write(rows: DataFrame, folder: str, name: str, head: str = "", tail: str = "", count: int | None = None) -> str:
    """Rows (xml), about ``count``, as model files of some thousand elements each; ``head`` and ``tail`` go around them, with the file's number for ``#``."""
    files = (rows.count() if count is None else count) // FILE_ROWS + 1
    number = F.pmod(F.xxhash64("xml"), F.lit(files))
    around = lambda text: F.regexp_replace(F.lit(text), "#", F.col("file").cast("string"))
    body = rows.withColumn("file", number).groupBy("file").agg(F.array_join(F.collect_list("xml"), "").alias("xml"))
    body = body.select("file", F.concat(F.lit("<opsa-mef name='tables'>"), around(head), "xml", around(tail), F.lit("</opsa-mef>")).alias("value"))
    body.write.partitionBy("file").text(f"{folder}/{name}")
    return f"{folder}/{name}/file=*/part-*"


def _orders(spark, sf_dir) -> tuple[DataFrame, int]:
    """(l_orderkey, parts, args, n): the distinct parts of every order, and their arguments in XML; and about how many orders there are."""
    lines = read(spark, sf_dir, "lineitem")
    orders = lines.where("l_partkey IS NOT NULL").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("parts"))
    args = F.transform("parts", lambda p: F.concat(F.lit("<basic-event name='P"), p.cast("string"), F.lit("'/>")))
    return orders.select("l_orderkey", "parts", F.array_join(F.array_sort(args), "").alias("args"), F.size("parts").alias("n")), lines.agg(F.approx_count_distinct("l_orderkey")).first()[0]


def _signature(spark, sf_dir) -> tuple:
    """Names, lengths and times of the tables' files: what has changed is loaded anew."""
    path = spark._jvm.org.apache.hadoop.fs.Path(str(sf_dir))
    left, found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True), []
    while left.hasNext():
        f = left.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(found))


def _loaded_once(spark, sf_dir, kind, make):
    key = (spark.sparkContext.applicationId, kind, _signature(spark, sf_dir))
    if key not in _loaded:
        _loaded[key] = make(f"{graphs._store(spark)}-{uuid.uuid4().hex[:8]}")
    return _loaded[key]


def tables_model(spark, sf_dir) -> model.Model:
    """The sound model, loaded once a session and folder."""

    def make(folder: str) -> model.Model:
        part, size, price = read(spark, sf_dir, "part"), F.col("p_size"), F.col("p_retailprice")
        laws = (
            _text("<float value='", price / 70000, "'/>"), _text("<mul><parameter name='scale'/><int value='", size, "'/></mul>"),
            _text("<exponential><float value='1e-7'/><system-mission-time/></exponential>"), _text("<ite><lt><int value='", size, "'/><int value='25'/></lt><float value='0.0104712041'/><parameter name='scale'/></ite>"),
        )
        law = F.element_at(F.array(*laws), (F.col("p_partkey") % 4 + 1).cast("int"))
        events = part.select(_text("<define-basic-event name='P", F.col("p_partkey"), "'><label>", F.col("p_name"), "</label><attributes><attribute name='size' value='", size, "'/></attributes>", law, "</define-basic-event>").alias("xml"))
        scale = spark.range(1).select(F.lit("<define-parameter name='scale'><float value='0.0010309278'/></define-parameter>").alias("xml"))
        files = [_write(events, folder, "parts", "<model-data>", "</model-data>"), _write(scale, folder, "scale", "<model-data>", "</model-data>")]

        orders, number = _orders(spark, sf_dir)
        form = F.when(F.col("n") == 1, "null").when(F.col("l_orderkey") % 3 == 0, "or").when((F.col("l_orderkey") % 3 == 1) | (F.col("n") == 2), "and").otherwise("atleast")
        orders = orders.withColumn("form", form)
        opened = _text("<", F.col("form"), F.when(F.col("form") == "atleast", " min='2'").otherwise(""), ">", F.col("args"), "</", F.col("form"), ">")
        gates = orders.select(_text("<define-gate name='O", F.col("l_orderkey"), "'>", opened, "</define-gate>").alias("xml"))
        files.append(_write(gates, folder, "orders", "<define-fault-tree name='orders#'>", "</define-fault-tree>", number))

        supplier = read(spark, sf_dir, "supplier")
        member = _text("<basic-event name='S", F.col("s_suppkey"), "'/>")
        groups = supplier.groupBy("s_nationkey").agg(F.array_join(F.sort_array(F.collect_list(member)), "").alias("members"), F.count("*").alias("n")).where("n >= 2")
        kind = F.when(F.col("s_nationkey") % 2 == 0, "beta-factor").otherwise("MGL")
        xml = _text("<define-CCF-group name='N", F.col("s_nationkey"), "' model='", kind, "'><members>", F.col("members"), "</members><distribution><float value='0.1'/></distribution><factor><float value='0.2'/></factor></define-CCF-group>")
        files.append(_write(groups.select(xml.alias("xml")), folder, "groups", "<define-fault-tree name='groups#'>", "</define-fault-tree>"))

        p = F.round((F.col("s_suppkey") % 9 + 1) / 10, 1)
        path = lambda state, *inside: _text("<path state='", state, "'>", *inside, "</path>")
        collect = lambda value: _text("<collect-expression><float value='", value, "'/></collect-expression>")
        key = F.col("s_suppkey")
        second = _text("<fork functional-event='B'>", path("yes", collect(F.lit(0.25)), _text("<sequence name='E", key, "-low'/>")), path("no", _text("<rule name='half'/>"), _text("<branch name='rest'/>")), "</fork>")
        tree = _text(
            "<define-event-tree name='T", key, "'><define-functional-event name='A'/><define-functional-event name='B'/><define-sequence name='E", key, "-low'><block><collect-expression><float value='0.5'/></collect-expression></block></define-sequence>",
            "<define-sequence name='E", key, "-high'><if><gt><float value='", p, "'/><float value='0.5'/></gt><collect-expression><float value='0.1'/></collect-expression><rule name='half'/></if></define-sequence>",
            "<define-branch name='rest'><sequence name='E", key, "-high'/></define-branch><initial-state><fork functional-event='A'>", path("yes", collect(p), second), path("no", collect(1 - p), _text("<sequence name='E", key, "-low'/>")), "</fork></initial-state></define-event-tree>",
            "<define-initiating-event name='I", key, "' event-tree='T", key, "'/>",
        )
        rule = spark.range(1).select(F.lit("<define-rule name='half'><collect-expression><float value='0.5'/></collect-expression></define-rule>").alias("xml"))
        files += [_write(supplier.select(tree.alias("xml")), folder, "trees"), _write(rule, folder, "rules")]
        return model.load(spark, files, Settings(approximation="rare-event"))

    return _loaded_once(spark, sf_dir, "sound", make)


PARTS = """WITH e AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_retailprice / 70000 WHEN 1 THEN 0.0010309278::DOUBLE * p_size WHEN 2 THEN 1 - exp(-(1e-7::DOUBLE * 8760)) ELSE CASE WHEN p_size < 25 THEN 0.0104712041::DOUBLE ELSE 0.0010309278::DOUBLE END END AS p FROM part)"""


@query(PARTS + " SELECT 'P' || p_partkey AS id, round(p, 9) AS p FROM e")
def xml_event_probabilities(spark, sf_dir):
    """Basic events from a file, by constants, parameters, a law over the mission time and conditions."""
    m = tables_model(spark, sf_dir)
    return evaluate.event_probabilities(m).where("id LIKE 'P%'").select("id", F.round("p", 9).alias("p"))


@query("SELECT 'P' || p_partkey AS id, p_name AS label, p_size::VARCHAR AS size FROM part")
def xml_labels(spark, sf_dir):
    """Labels and attributes of elements in a file."""
    m = tables_model(spark, sf_dir)
    at = m.nodes.where("tag = 'define-basic-event'").select("file", "node", F.col("attrs")["name"].alias("id"))
    size = m.attributes.where("name = 'size'").select("file", "node", F.col("value").alias("size"))
    return at.join(m.labels, ["file", "node"]).join(size, ["file", "node"]).select("id", "label", "size")


ORDERS = """, l AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p_partkey FROM lineitem),
g AS (SELECT o, count(*) AS n, CASE WHEN count(*) = 1 THEN 'null' WHEN o % 3 = 0 THEN 'or' WHEN o % 3 = 1 OR count(*) = 2 THEN 'and' ELSE 'atleast' END AS form FROM l GROUP BY o)"""


@query(PARTS + ORDERS + " SELECT 'O' || o AS id, form AS connective, CASE WHEN form = 'atleast' THEN 2 END AS min_num, n::BIGINT AS n FROM g")
def xml_gates(spark, sf_dir):
    """Gates from a file with their connectives and the number of resolved arguments."""
    m = tables_model(spark, sf_dir)
    counts = m.gate_args.where("arg_id IS NOT NULL").groupBy(F.col("gate_id").alias("id")).agg(F.count("*").alias("n"))
    return m.gates.select("id", "connective", "min_num").join(counts, "id")


@query(PARTS + ORDERS + """, x AS (SELECT o, form, exp(sum(ln(1 - p))) AS none, exp(sum(ln(p))) AS every, sum(p / (1 - p)) AS odds FROM l JOIN g USING (o) JOIN e USING (p_partkey) GROUP BY o, form)
SELECT 'O' || o AS id, round(CASE form WHEN 'and' THEN every WHEN 'atleast' THEN 1 - none - none * odds ELSE 1 - none END, 8) AS p FROM x""")
def xml_gate_probabilities(spark, sf_dir):
    """Probabilities of all gates of a file, arguments independent."""
    m = tables_model(spark, sf_dir)
    return evaluate.gate_probabilities(m, combined=False).where("id LIKE 'O%'").select("id", F.round("p", 8).alias("p"))


@query("""WITH m AS (SELECT s_nationkey AS g, s_suppkey, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier), k AS (SELECT g, n, s_suppkey, CASE WHEN g % 2 = 0 THEN 'beta' ELSE 'mgl' END AS kind FROM m WHERE n >= 2)
SELECT 'S' || s_suppkey AS id, round(CASE kind WHEN 'beta' THEN 1 - (1 - 0.8 * 0.1) * (1 - 0.2 * 0.1) ELSE 1 - (1 - 0.8 * 0.1) * pow(1 - 0.2 * 0.1 / (n - 1), n - 1) END, 9) AS p FROM k""")
def xml_common_causes(spark, sf_dir):
    """Members of common-cause groups of a file, the groups' models applied: each one an OR over the events that it is in."""
    m = tables_model(spark, sf_dir)
    return evaluate.gate_probabilities(m, combined=False).where("id LIKE 'S%'").select("id", F.round("p", 9).alias("p"))


@query("""WITH s AS (SELECT s_suppkey AS k, round((s_suppkey % 9 + 1) / 10.0, 1)::DOUBLE AS p FROM supplier)
SELECT 'I' || k AS ie, 'E' || k || '-low' AS sequence, round(p * 0.25 * 0.5, 9) AS p FROM s UNION ALL SELECT 'I' || k, 'E' || k || '-low', round((1 - p) * 0.5, 9) FROM s
UNION ALL SELECT 'I' || k, 'E' || k || '-high', round(p * 0.5 * CASE WHEN p > 0.5 THEN 0.1 ELSE 0.5 END, 9) FROM s""")
def xml_event_trees(spark, sf_dir):
    """The walk through event trees of a file: forks, a named branch, rules, blocks and conditions."""
    m = tables_model(spark, sf_dir)
    return trees.walk(m).select("ie", "sequence", F.round("p", 9).alias("p"))


@query("SELECT 0::BIGINT AS violations, count(*)::BIGINT AS events FROM (SELECT p_partkey FROM part UNION ALL SELECT s_suppkey FROM (SELECT *, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier) WHERE n >= 2)")
def xml_sound(spark, sf_dir):
    """A sound model has no violations; all its basic events are there."""
    m = tables_model(spark, sf_dir)
    return m.violations.agg(F.count("*").alias("violations")).join(m.basic_events.agg(F.count("*").alias("events")))  # one row each


def broken_model(spark, sf_dir) -> model.Model:
    """Substitutions of orders, and what customers and nations do wrong."""

    def make(folder: str) -> model.Model:
        orders, number = _orders(spark, sf_dir)
        orders = orders.where("n >= 2").withColumn("one", F.array_min("parts"))
        key, form = F.col("l_orderkey"), F.when(F.col("l_orderkey") % 5 == 4, "or").otherwise("and")
        source = F.when(key % 4 == 2, _text("<source>", F.col("args"), "</source>")).when(key % 4 == 3, _text("<source><basic-event name='P", F.col("one"), "'/></source>")).otherwise("")
        target = F.when(key % 4 == 0, _text("<constant value='", F.when(key % 8 == 0, "false").otherwise("true"), "'/>")).otherwise("<basic-event name='X'/>")
        subs = orders.select(_text("<define-substitution name='U", key, "' type='", F.when(key % 4 == 3, "exchange-event").otherwise("recovery-rule"), "'><hypothesis><", form, ">", F.col("args"), "</", form, "></hypothesis>", source, "<target>", target, "</target></define-substitution>").alias("xml"))
        events = read(spark, sf_dir, "part").select(_text("<define-basic-event name='P", F.col("p_partkey"), "'><float value='0.1'/></define-basic-event>").alias("xml"))
        shared = spark.range(1).select(F.lit("<define-basic-event name='X'><float value='0.1'/></define-basic-event><define-parameter name='hours' unit='hours'><float value='0.1'/></define-parameter>").alias("xml"))
        files = [_write(subs, folder, "subs", count=number), _write(events, folder, "parts", "<model-data>", "</model-data>"), _write(shared, folder, "shared", "<model-data>", "</model-data>")]

        c = F.col("c_custkey")
        wrong = (
            _text("<define-gate name='G", c, "'><and><basic-event name='P1'/></and></define-gate>"), _text("<define-gate name='G", c, "'><or><basic-event name='P1'/><basic-event name='Q", c, "'/></or></define-gate>"),
            _text("<define-basic-event name='P", c, "'><float value='0.1'/></define-basic-event>"), _text("<define-basic-event name='B", c, "'><parameter name='hours' unit='years'/></define-basic-event>"),
            _text("<define-basic-event name='B", c, "'/>"), _text("<define-gate name='G", c, "'><not><constant value='true'/></not></define-gate>"), _text("<define-basic-event name='B", c, "'><float value='1,5'/></define-basic-event>"),
            _text("<define-gate name='a.", c, "'><or><basic-event name='P1'/><basic-event name='P2'/></or></define-gate>"),
        )
        customers = read(spark, sf_dir, "customer").select(F.element_at(F.array(*wrong), (c % 8 + 1).cast("int")).alias("xml"))
        files.append(_write(customers, folder, "customers", "<define-fault-tree name='customers#'>", "</define-fault-tree>"))

        n = F.col("n_nationkey")
        tree = _text(
            "<define-event-tree name='T", n, "'><define-functional-event name='A'/><define-functional-event name='B'/><define-sequence name='L", n, "'><event-tree name='T", (n * 3 + 1) % 25, "'/></define-sequence><initial-state>",
            F.when(n % 5 == 0, "<event-tree name='T0'/>").when(n % 5 == 1, "<collect-expression><float value='0.1'/></collect-expression><collect-formula><basic-event name='P1'/></collect-formula>").when(n % 5 == 2, "<rule name='none'/>").otherwise(""),
            F.when(n % 2 == 0, _text("<fork functional-event='B'><path state='y'><fork functional-event='A'><path state='y'><sequence name='L", n, "'/></path></fork></path></fork>")).otherwise(_text("<sequence name='L", n, "'/>")),
            "</initial-state></define-event-tree>",
        )
        files.append(_write(read(spark, sf_dir, "nation").select(tree.alias("xml")), folder, "trees"))
        return model.load(spark, files, Settings(approximation="rare-event", probability_analysis=True))

    return _loaded_once(spark, sf_dir, "broken", make)


@query("""WITH l AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem), h AS (SELECT o, count(*) AS n FROM l GROUP BY o HAVING count(*) >= 2)
SELECT 'U' || o AS name, CASE WHEN o % 4 = 0 THEN CASE WHEN o % 5 <> 4 AND n = 2 THEN 'delete-terms' END WHEN o % 4 = 1 THEN CASE WHEN o % 5 <> 4 THEN 'recovery-rule' END
WHEN o % 5 = 4 THEN NULL WHEN o % 4 = 2 THEN 'recovery-rule' ELSE 'exchange-event' END AS kind, n::INTEGER AS hypothesis, (CASE o % 4 WHEN 2 THEN n WHEN 3 THEN 1 ELSE 0 END)::INTEGER AS source FROM h""")
def xml_substitutions(spark, sf_dir):
    """Substitutions of a file, classified."""
    from ..operators import substitutions

    m = broken_model(spark, sf_dir)
    return m.substitutions.select("name", substitutions.kind().alias("kind"), F.size("hypothesis").alias("hypothesis"), F.size("source").alias("source"))


@query("""WITH RECURSIVE l AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem), h AS (SELECT o, count(*) AS n FROM l GROUP BY o HAVING count(*) >= 2), c AS (SELECT c_custkey % 8 AS k, count(*)::BIGINT AS n FROM customer GROUP BY 1),
t AS (SELECT n_nationkey AS n FROM nation), s AS (SELECT * FROM h WHERE o % 4 IN (2, 3)), sp AS (SELECT s.o, l.p FROM s JOIN l USING (o) WHERE o % 4 = 2 UNION SELECT s.o, min(l.p) FROM s JOIN l USING (o) WHERE o % 4 = 3 GROUP BY s.o), hp AS (SELECT s.o, l.p FROM s JOIN l USING (o)),
w AS (SELECT n AS a, n AS b FROM t UNION SELECT a, (b * 3 + 1) % 25 FROM w)
SELECT 'ValidityError' AS code, 'needs 2 or more arguments' AS detail, n FROM c WHERE k = 0 UNION ALL SELECT 'UndefinedElement', 'argument of a gate', n FROM c WHERE k = 1
UNION ALL SELECT 'DuplicateElementError', 'event defined more than once', count(*) FROM customer WHERE c_custkey % 8 = 2 AND c_custkey IN (SELECT p_partkey FROM part)
UNION ALL SELECT 'ValidityError', 'unit differs from the parameter''s', n FROM c WHERE k = 3 UNION ALL SELECT 'ValidityError', 'no expression', n FROM c WHERE k = 4
UNION ALL SELECT 'LogicError', 'complement of a constant', n FROM c WHERE k = 5 UNION ALL SELECT 'ValidityError', 'not a number of this kind', n FROM c WHERE k = 6
UNION ALL SELECT 'ValidityError', 'name is empty or holds a point', n FROM c WHERE k = 7
UNION ALL SELECT 'ValidityError', 'declarative with target true', count(*) FROM h WHERE o % 8 = 4
UNION ALL SELECT 'ValidityError', 'declared type is not the deduced one', count(*) FROM h WHERE o % 8 <> 4 AND (o % 4 = 0 OR o % 5 = 4)
UNION ALL SELECT 'ValidityError', 'source in another hypothesis', count(*) FROM sp WHERE EXISTS (SELECT 1 FROM hp WHERE hp.p = sp.p AND hp.o <> sp.o)
UNION ALL SELECT 'ValidityError', 'links belong into sequences', count(*) FROM t WHERE n % 5 = 0 UNION ALL SELECT 'UndefinedElement', 'rule of an instruction', count(*) FROM t WHERE n % 5 = 2
UNION ALL SELECT 'ValidityError', 'functional event out of order', count(*) FROM t WHERE n % 2 = 0
UNION ALL SELECT 'ValidityError', 'collects both expressions and formulas', count(DISTINCT a) FROM w WHERE b % 5 = 1""")
def xml_violations(spark, sf_dir):
    """Violations of a model with many defects, counted by kind; cycles have a query of their own."""
    m = broken_model(spark, sf_dir)
    detail = F.when(F.col("detail").startswith("argument of gate"), "argument of a gate").when(F.col("detail").startswith("functional event out of order"), "functional event out of order").otherwise(F.split("detail", ": ")[0])
    counted = m.violations.where("code <> 'CycleError'").groupBy("code", detail.alias("detail")).agg(F.count("*").alias("n"))
    return counted.select("code", "detail", "n")


@query("""WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey * 3 + 1) % 25 AS b FROM nation), w AS (SELECT a AS s, b AS e, [a] AS path FROM e UNION ALL SELECT w.s, e.b, list_append(path, w.e) FROM w JOIN e ON e.a = w.e WHERE w.e <> w.s AND NOT list_contains(path, w.e)),
c AS (SELECT * FROM w WHERE e = s) SELECT min(path) AS nodes, len(path)::INTEGER AS length FROM (SELECT list_sort(path) AS path FROM c) GROUP BY path""")
def xml_link_cycles(spark, sf_dir):
    """Event trees of a file whose links lead back to themselves: the trees of each cycle."""
    m = broken_model(spark, sf_dir)
    paths = m.violations.where("code = 'CycleError' AND detail = 'cycle among event-tree links'").select(F.split("entity", "->").alias("p"))
    trees_of = F.transform(F.slice("p", F.lit(1), F.size("p") - 1), lambda x: F.substring(x, 2, 9).cast("int"))
    return paths.select(F.sort_array(trees_of).alias("nodes"), (F.size("p") - 1).alias("length"))
