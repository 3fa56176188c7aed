"""Elements, references, graphs, common causes, event trees and substitutions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import ccf, elements, eventtrees, graphs, references, substitutions
from . import query, read

PATHS = """WITH p AS (SELECT s_suppkey, s_name, n_name, r_name, CASE WHEN s_suppkey % 3 = 0 THEN 'public' WHEN s_suppkey % 3 = 1 THEN 'private' END AS own, CASE WHEN n_nationkey % 2 = 0 THEN 'private' ELSE 'public' END AS parent
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def suppliers(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    own = F.when(F.col("s_suppkey") % 3 == 0, "public").when(F.col("s_suppkey") % 3 == 1, "private")
    parent = F.when(F.col("n_nationkey") % 2 == 0, "private").otherwise("public")
    return s.withColumns({"role": elements.inherited_role(own, parent), "base_path": F.concat_ws(".", "r_name", "n_name")})


@query(PATHS + """SELECT s_suppkey, r_name || '.' || n_name || '.' || s_name AS full_path, CASE WHEN coalesce(own, parent) = 'public' THEN s_name ELSE r_name || '.' || n_name || '.' || s_name END AS id FROM p""")
def id_mangling(spark, sf_dir):
    s = suppliers(spark, sf_dir)
    return s.select("s_suppkey", elements.full_path(F.col("base_path"), F.col("s_name")).alias("full_path"), elements.element_id(F.col("role"), F.col("base_path"), F.col("s_name")).alias("id"))


@query(PATHS + "SELECT coalesce(own, parent) AS role, count(*)::BIGINT AS n FROM p GROUP BY 1")
def role_inheritance(spark, sf_dir):
    return suppliers(spark, sf_dir).groupBy("role").agg(F.count("*").alias("n"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE n_name END AS owner, r_name AS area, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE 'yes' END AS checked
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def attribute_inheritance(spark, sf_dir):
    """Attributes of region, nation and supplier: the nearest one counts; 'checked' is removed from every fifth supplier."""
    s = suppliers(spark, sf_dir)
    region = F.create_map(F.lit("area"), F.col("r_name"), F.lit("owner"), F.col("r_name"))
    nation = F.create_map(F.lit("owner"), F.col("n_name"), F.lit("checked"), F.lit("yes"))
    own = F.when(F.col("s_suppkey") % 2 == 0, F.create_map(F.lit("owner"), F.col("s_name")))
    s = s.withColumn("a", elements.inherit_attributes(elements.inherit_attributes(region, nation), own))
    s = s.withColumn("a", F.when(F.col("s_suppkey") % 5 == 0, elements.without_attribute(F.col("a"), "checked")).otherwise(F.col("a")))
    return s.select("s_suppkey", F.col("a")["owner"].alias("owner"), F.col("a")["area"].alias("area"), F.col("a")["checked"].alias("checked"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN '' WHEN p_partkey % 4 = 1 THEN p_name || '.x' ELSE p_name END AS name FROM part WHERE p_partkey % 4 < 2 OR contains(p_name, '.')""")
def bad_names(spark, sf_dir):
    """Names that are empty or hold a point: a fourth of the parts each is renamed so."""
    name = F.when(F.col("p_partkey") % 4 == 0, "").when(F.col("p_partkey") % 4 == 1, F.concat("p_name", F.lit(".x"))).otherwise(F.col("p_name"))
    return read(spark, sf_dir, "part").select("p_partkey", name.alias("name")).where(elements.bad_name(F.col("name")))


@query("""WITH e AS (SELECT 'r' || r_regionkey AS id FROM region UNION ALL SELECT 'r' || n_regionkey FROM nation UNION ALL SELECT 'n' || n_nationkey FROM nation)
SELECT id, count(*)::BIGINT AS n FROM e GROUP BY id HAVING count(*) > 1""")
def duplicate_ids(spark, sf_dir):
    """Ids unique across kinds of events: three kinds in one table, counted."""
    region, nation = read(spark, sf_dir, "region"), read(spark, sf_dir, "nation")
    ids = elements.union([region.select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("id")), nation.select(F.concat(F.lit("r"), F.col("n_regionkey")).alias("id")), nation.select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("id"))])
    return elements.duplicates(ids, "id")


@query("""WITH e AS (SELECT 'r' || n_regionkey AS base, 'n' || n_nationkey AS name, n_nationkey % 2 = 0 AS public FROM nation),
r AS (SELECT c_custkey, 'r' || (c_custkey % 7) AS base, 'n' || c_nationkey AS ref FROM customer)
SELECT c_custkey, coalesce(l.base || '.' || l.name, CASE WHEN g.public THEN g.base || '.' || g.name END) AS path FROM r LEFT JOIN e l ON l.base = r.base AND l.name = r.ref LEFT JOIN e g ON g.name = r.ref AND g.public""")
def resolve_local_then_public(spark, sf_dir):
    """Customers refer to nations from a region: in that region first, then public nations anywhere."""
    nation = read(spark, sf_dir, "nation").select(F.concat(F.lit("r"), F.col("n_regionkey")).alias("base"), F.concat(F.lit("n"), F.col("n_nationkey")).alias("name"), F.when(F.col("n_nationkey") % 2 == 0, "public").otherwise("private").alias("role"))
    path = elements.full_path(F.col("base"), F.col("name"))
    entities = nation.select(elements.element_id(F.col("role"), F.col("base"), F.col("name")).alias("id"), "role", path.alias("full_path"), F.lit("gate").alias("kind"))
    refs = read(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("r"), F.col("c_custkey") % 7).alias("base_path"), F.concat(F.lit("n"), F.col("c_nationkey")).alias("ref"))
    found = references.resolve(refs, entities)
    return found.join(entities.select("id", F.col("full_path").alias("path")), "id", "left").select("c_custkey", "path")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')")
def undefined_references(spark, sf_dir):
    known = read(spark, sf_dir, "customer").where("c_mktsegment <> 'BUILDING'")
    return elements.undefined(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), known, "o_custkey", "c_custkey").select("o_orderkey", "o_custkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey, p_type AS defined_unit FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type <> list_extract(['ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD'], l_suppkey % 6 + 1)")
def unit_mismatches(spark, sf_dir):
    """Line items whose unit, dealt by supplier, is not the one that their part is defined with."""
    units = F.array(*map(F.lit, ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")))
    refs = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("ref"), F.get(units, (F.col("l_suppkey") % 6).cast("int")).alias("unit"))
    found = references.unit_mismatch(refs, read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("unit")))
    return found.select("l_orderkey", "l_linenumber", F.col("ref").alias("l_partkey"), "defined_unit")


EDGES = """WITH RECURSIVE e AS (SELECT 'o' || o_orderkey AS a, 'c' || o_custkey AS b FROM orders UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"""


def hierarchy(spark, sf_dir):
    edge = lambda t, a, x, b, y: read(spark, sf_dir, t).select(F.concat(F.lit(a), F.col(x)).alias("a"), F.concat(F.lit(b), F.col(y)).alias("b"))
    return elements.union([edge("orders", "o", "o_orderkey", "c", "o_custkey"), edge("customer", "c", "c_custkey", "n", "c_nationkey"), edge("nation", "n", "n_nationkey", "r", "n_regionkey")])


@query(EDGES + ", t AS (SELECT a, b FROM e UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a) SELECT b, count(*)::BIGINT AS below FROM t GROUP BY b")
def hierarchy_closure(spark, sf_dir):
    return graphs.closure(hierarchy(spark, sf_dir)).groupBy("b").agg(F.count("*").alias("below"))


@query(EDGES + """, l AS (SELECT DISTINCT b AS node, 0 AS level FROM e WHERE b NOT IN (SELECT a FROM e) UNION SELECT e.a, l.level + 1 FROM l JOIN e ON e.b = l.node)
SELECT level, count(*)::BIGINT AS nodes FROM (SELECT node, max(level) AS level FROM l GROUP BY node) GROUP BY level""")
def topo_levels(spark, sf_dir):
    placed, _ = graphs.levels(hierarchy(spark, sf_dir))
    return placed.groupBy("level").agg(F.count("*").alias("nodes"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT n_nationkey AS a, (n_nationkey * 3 + 1) % 25 AS b FROM nation),
w AS (SELECT a AS s, b AS e, [a] AS path FROM e UNION ALL SELECT w.s, e.b, list_append(path, w.e) FROM w JOIN e ON e.a = w.e WHERE w.e > w.s AND NOT list_contains(path, w.e))
SELECT array_to_string(list_append(path, e), '->') AS path FROM w WHERE e = s""")
def cycle_paths(spark, sf_dir):
    """Nations that refer to each other by a rule with cycles."""
    edges = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("a"), ((F.col("n_nationkey").cast("long") * 3 + 1) % 25).alias("b")).distinct()
    return graphs.cycle_paths(edges)


MEMBERS = "m AS (SELECT s_nationkey AS g, s_suppkey AS s, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS o, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier), k AS (SELECT g, max(n) AS n FROM m WHERE n >= 2 GROUP BY g)"
CHOOSE = "round(exp(lgamma(n) - lgamma(k) - lgamma(n - k + 1)))"


def members(spark, sf_dir, at_most=None):
    """Suppliers of a nation as a group of 2 members or more; with ``at_most``, dealt to groups of that many members at most."""
    nation = Window.partitionBy("s_nationkey")
    rows = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("g"), (F.row_number().over(nation.orderBy("s_suppkey")) - 1).alias("o"), F.col("s_suppkey").cast("string").alias("event_id"), F.count("*").over(nation).alias("n")).where("n >= 2")
    part = F.pmod("o", F.ceil(F.col("n") / at_most)).cast("int") if at_most else F.lit(0)
    return rows.select(F.struct("g", part.alias("part")).alias("group_id"), F.col("o").alias("ordinal"), "event_id", F.col("n").cast("int").alias("n"))


def factors(spark, sf_dir, model, least, expr):
    """Levels from ``least`` to n with a factor each."""
    groups = members(spark, sf_dir).select("group_id", "n").distinct()
    levels = F.sequence(F.lit(least), F.col("n")) if least else F.array("n")
    rows = groups.select("group_id", "n", F.explode(levels).alias("level"))
    return rows.select("group_id", F.lit(model).alias("model"), "n", F.lit(0.1).alias("q_total"), "level", expr.alias("factor"))


def probabilities(found):
    return ccf.level_probabilities(found).select("group_id.g", F.col("level").cast("int").alias("k"), F.round("q", 12).alias("q"))


@query(f"WITH {MEMBERS} SELECT g, 1 AS k, round(0.9 * 0.1::DOUBLE, 12) AS q FROM k UNION ALL SELECT g, n::INT, round(0.1 * 0.1::DOUBLE, 12) FROM k")
def ccf_beta(spark, sf_dir):
    return probabilities(factors(spark, sf_dir, "beta-factor", 0, F.lit(0.1)))


@query(f"""WITH {MEMBERS}, l AS (SELECT g, n, unnest(range(1, n + 1)) AS k FROM k), r AS (SELECT g, n, k, CASE WHEN k = 1 THEN 1 ELSE 0.1 / k END AS f FROM l),
p AS (SELECT g, n, k, product(f) OVER w AS f, coalesce(lead(f) OVER w, 0) AS nf FROM r WINDOW w AS (PARTITION BY g ORDER BY k)) SELECT g, k::INT AS k, round(f * (1 - nf) * 0.1 / {CHOOSE}, 12) AS q FROM
(SELECT g, n, k, (SELECT product(f) FROM r r2 WHERE r2.g = p.g AND r2.k <= p.k) AS f, nf FROM p) p""")
def ccf_mgl(spark, sf_dir):
    return probabilities(factors(spark, sf_dir, "MGL", 2, F.lit(0.1) / F.col("level")))


@query(f"""WITH {MEMBERS}, l AS (SELECT g, n, unnest(range(1, n + 1)) AS k FROM k), r AS (SELECT g, n, k, pow(0.5, k) AS f FROM l), s AS (SELECT g, sum(k * f) AS s FROM r GROUP BY g)
SELECT r.g, k::INT AS k, round(k * f / s / {CHOOSE} * 0.1, 12) AS q FROM r JOIN s USING (g)""")
def ccf_alpha(spark, sf_dir):
    return probabilities(factors(spark, sf_dir, "alpha-factor", 1, F.pow(F.lit(0.5), F.col("level"))))


@query(f"WITH {MEMBERS}, l AS (SELECT g, n, unnest(range(1, n + 1)) AS k FROM k) SELECT g, k::INT AS k, round(0.1 / n, 12) AS q FROM l")
def ccf_phi(spark, sf_dir):
    return probabilities(factors(spark, sf_dir, "phi-factor", 1, 1 / F.col("n")))


COMBOS = f"WITH {MEMBERS}, d AS (SELECT g, (o % ceil(n / 8.0)::BIGINT)::INT AS part, s, o FROM m WHERE n >= 2), r AS (SELECT *, row_number() OVER (PARTITION BY g, part ORDER BY o) - 1 AS i, count(*) OVER (PARTITION BY g, part) AS size FROM d), c AS (SELECT g, part, unnest(range(1, (1 << max(size)::INT)::BIGINT)) AS mask FROM r GROUP BY g, part), e AS (SELECT c.g, c.part, c.mask, '[' || string_agg(s::VARCHAR, ' ' ORDER BY o) || ']' AS event, count(*) AS level FROM c JOIN r ON r.g = c.g AND r.part = c.part AND (c.mask >> r.i::INT) & 1 = 1 GROUP BY c.g, c.part, c.mask)"


@query(COMBOS + " SELECT g, part, level::INT AS level, event FROM e")
def ccf_combinations(spark, sf_dir):
    """Every combination of members of groups of 8 at most, to which all suppliers of a nation with two or more are dealt."""
    found = ccf.combinations(members(spark, sf_dir, 8))
    return found.select("group_id.g", "group_id.part", "level", ccf.event_name(F.col("members")).alias("event"))


@query(COMBOS + " SELECT r.s::VARCHAR AS member, count(*)::BIGINT AS events, min(e.event) AS first FROM e JOIN r ON r.g = e.g AND r.part = e.part AND (e.mask >> r.i::INT) & 1 = 1 WHERE e.level <= 2 GROUP BY 1")
def ccf_proxy_gates(spark, sf_dir):
    """The OR gate that stands for each member of those groups, over events of levels 1 and 2."""
    found = ccf.combinations(members(spark, sf_dir, 8)).where("level <= 2").withColumn("event_id", ccf.event_name(F.col("members")))
    return ccf.proxy_args(found).groupBy(F.col("gate_id").alias("member")).agg(F.count("*").alias("events"), F.min("arg_id").alias("first"))


@query("""WITH f AS (SELECT s_nationkey AS g, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS o, CASE WHEN s_suppkey % 4 = 0 THEN (s_suppkey % 9 + 2)::INT END AS given FROM supplier),
b AS (SELECT *, max(CASE WHEN given IS NOT NULL THEN o END) OVER (PARTITION BY g ORDER BY o) AS lo FROM f)
SELECT b.g, b.o::INT AS o, (CASE WHEN b.lo IS NULL THEN 2 + b.o - 1 ELSE h.given + b.o - b.lo END)::INT AS level FROM b LEFT JOIN f h ON h.g = b.g AND h.o = b.lo""")
def ccf_default_levels(spark, sf_dir):
    """Levels left out follow the last one given."""
    group = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    rows = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("group_id"), F.row_number().over(group).alias("ordinal"), F.when(F.col("s_suppkey") % 4 == 0, (F.col("s_suppkey") % 9 + 2).cast("int")).alias("level"), F.lit(2).alias("min_level"))
    return ccf.factor_levels(rows).select(F.col("group_id").alias("g"), F.col("ordinal").alias("o"), "level")


@query("SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS ord FROM events")
def fe_order(spark, sf_dir):
    """Events of a user as functional events, by position."""
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("tree"), F.col("event_type").alias("name"), F.struct("ts", "event_id").alias("ordinal"))
    return eventtrees.functional_order(rows).select(F.col("tree").alias("user_id"), F.col("name").alias("event_type"), "ord")


ORDERED = "o AS (SELECT user_id AS tree, event_id AS f, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 WHEN 'purchase' THEN 4 ELSE 5 END AS ord, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS parent FROM events)"


@query(f"WITH {ORDERED} SELECT c.tree, c.f AS fork, c.ord, p.ord AS parent_ord FROM o c JOIN o p ON p.tree = c.tree AND p.f = c.parent WHERE c.ord <= p.ord")
def et_order_violations(spark, sf_dir):
    """Each event as a fork after the user's previous one: those that go back in the order of types."""
    order = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", 2).when(F.col("event_type") == "signup", 3).when(F.col("event_type") == "purchase", 4).otherwise(5)
    previous = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    forks = read(spark, sf_dir, "events").select(F.col("user_id").alias("tree"), F.col("event_id").alias("fork_id"), previous.alias("parent_fork"), order.alias("ord"))
    return eventtrees.order_violations(forks).select("tree", F.col("fork_id").alias("fork"), "ord", "parent_ord")


@query("""WITH s AS (SELECT DISTINCT event_type AS e FROM events), p AS (SELECT user_id, count(*) FILTER (event_type = 'click')::DOUBLE / count(*) AS click, count(*) FILTER (event_type = 'error')::DOUBLE / count(*) AS error FROM events GROUP BY 1)
SELECT user_id AS ie, c || '-' || e AS sequence, round((CASE c WHEN 'S' THEN 1 - click ELSE click END) * (CASE e WHEN 'S' THEN 1 - error ELSE error END), 9) AS p FROM p, (VALUES ('S'), ('F')) x(c), (VALUES ('S'), ('F')) y(e)""")
def et_walk(spark, sf_dir):
    """An event tree of two functional events for each user: the walk to its four sequences."""
    share = lambda t: F.count_if(F.col("event_type") == t) / F.count("*")
    users = read(spark, sf_dir, "events").groupBy("user_id").agg(share("click").alias("click"), share("error").alias("error"))
    first = [("i", None, None, "fork", "a", F.lit(1.0))]
    click = [("a", "click", s, "fork", f"b{s}", F.col("click") if s == "F" else 1 - F.col("click")) for s in "SF"]
    error = [(f"b{c}", "error", s, "sequence", f"{c}-{s}", F.col("error") if s == "F" else 1 - F.col("error")) for c in "SF" for s in "SF"]
    row = lambda b, e, s, t, n, p: F.struct(F.lit(b).alias("branch"), F.lit(e).cast("string").alias("event"), F.lit(s).cast("string").alias("state"), F.lit(t).alias("target"), F.lit(n).alias("next"), p.alias("p"))
    branches = users.select(F.col("user_id").alias("tree"), F.inline(F.array(*[row(*x) for x in first + click + error])))
    starts = users.select(F.col("user_id").alias("ie"), F.col("user_id").alias("tree"), F.lit("i").alias("branch"))
    return eventtrees.walk(starts, branches).select("ie", "sequence", F.round("p", 9).alias("p"))


@query("SELECT user_id, event_type, round(product(1 - value / 1000.0), 6) AS p FROM events GROUP BY 1, 2")
def collect_expression_product(spark, sf_dir):
    rows = read(spark, sf_dir, "events").withColumn("value", 1 - F.col("value") / 1000.0)
    return eventtrees.collected_product(rows, "user_id", "event_type").withColumn("p", F.round("p", 6))


@query("SELECT user_id, event_type, arg_max(value > 50, (ts, event_id)) AS state FROM events GROUP BY 1, 2")
def set_house_last(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("owner"), F.col("event_type").alias("name"), F.struct("ts", "event_id").alias("ordinal"), (F.col("value") > 50).alias("state"))
    return eventtrees.last_house_states(rows).select(F.col("owner").alias("user_id"), F.col("name").alias("event_type"), "state")


@query("SELECT user_id AS tree FROM events WHERE event_type IN ('click', 'error') GROUP BY 1 HAVING count(DISTINCT event_type) > 1")
def link_homogeneity(spark, sf_dir):
    """Trees that collect both expressions (clicks) and formulas (errors)."""
    kind = F.when(F.col("event_type") == "click", "collect-expression").when(F.col("event_type") == "error", "collect-formula")
    return eventtrees.mixed_collections(read(spark, sf_dir, "events").select(F.col("user_id").alias("tree"), kind.alias("kind")))


@query("SELECT user_id AS fork_id, event_type AS state, count(*)::BIGINT AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def fork_states(spark, sf_dir):
    return eventtrees.duplicate_states(read(spark, sf_dir, "events").select(F.col("user_id").alias("fork_id"), F.col("event_type").alias("state")))


SUBS = """WITH l AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem), h AS (SELECT o, list_sort(list(p)) AS hyp FROM l GROUP BY o),
s AS (SELECT o, hyp, CASE (o // 4) % 5 WHEN 0 THEN 'and' WHEN 1 THEN 'or' WHEN 2 THEN 'atleast' WHEN 3 THEN 'and' ELSE 'null' END AS connective, CASE WHEN (o // 4) % 5 = 2 THEN 2 + o % 2 END AS min_num,
CASE WHEN o % 4 < 2 THEN []::BIGINT[] WHEN (o // 20) % 4 = 0 THEN list_append(hyp[1:1], -1) WHEN (o // 20) % 4 = 1 THEN [-1::BIGINT] WHEN o % 4 = 2 THEN hyp ELSE hyp[1:1] END AS src,
CASE WHEN o % 4 <> 0 OR (o // 4) % 7 = 0 THEN o % 2000 END AS target, CASE WHEN o % 4 = 0 AND (o // 4) % 7 <> 0 THEN o % 8 = 4 WHEN o % 20 = 3 THEN false END AS const FROM h)"""


def subs(spark, sf_dir):
    """A substitution per order: hypothesis its parts, under five connectives; sources all of them, one, one more or another one."""
    rows = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("name")).agg(F.array_sort(F.collect_set("l_partkey")).alias("hypothesis"))
    name, none = F.col("name"), F.array().cast("array<bigint>")
    form, variant, part = F.floor(name / 4) % 5, F.floor(name / 20) % 4, name % 4
    one, other = F.slice("hypothesis", 1, 1), F.array(F.lit(-1).cast("long"))
    constant = (part == 0) & (F.floor(name / 4) % 7 != 0)
    source = F.when(part < 2, none).when(variant == 0, F.concat(one, other)).when(variant == 1, other).when(part == 2, F.col("hypothesis")).otherwise(one)
    return rows.select(
        "name", F.element_at(F.array(*map(F.lit, ("and", "or", "atleast", "and", "null"))), (form + 1).cast("int")).alias("connective"), F.when(form == 2, 2 + name % 2).alias("min_num"), "hypothesis",
        source.alias("source"), F.when(~constant, name % 2000).alias("target_event"), F.when(constant, name % 8 == 4).when(name % 20 == 3, False).alias("target_const"),
        (F.size("hypothesis") > 6).alias("complemented"), (F.size("hypothesis") == 1).alias("other_kinds"),
    )


@query(SUBS + """ SELECT o AS name, CASE WHEN len(src) = 0 THEN CASE WHEN const IS NOT NULL THEN CASE WHEN (connective = 'atleast' AND min_num = 2) OR (connective = 'and' AND len(hyp) = 2) THEN 'delete-terms' END WHEN connective = 'and' AND target IS NOT NULL THEN 'recovery-rule' END
WHEN target IS NULL OR connective NOT IN ('and', 'null') THEN NULL WHEN len(src) = len(hyp) THEN CASE WHEN list_has_all(hyp, src) THEN 'recovery-rule' END
WHEN len(src) = 1 THEN CASE WHEN list_contains(hyp, src[1]) THEN 'exchange-event' END END AS kind FROM s""")
def subst_classify(spark, sf_dir):
    return subs(spark, sf_dir).select("name", substitutions.kind().alias("kind"))


@query(SUBS + """ SELECT * FROM (SELECT o AS name, CASE WHEN len(hyp) = 1 THEN 'hypothesis over other than basic events' WHEN len(hyp) > 6 THEN 'hypothesis with complements' WHEN len(src) = 0 AND const THEN 'declarative with target true'
WHEN len(src) > 0 AND connective = 'atleast' THEN 'connective of a non-declarative hypothesis' WHEN len(src) > 0 AND const = false THEN 'non-declarative with target false' END AS problem FROM s) WHERE problem IS NOT NULL""")
def subst_problems(spark, sf_dir):
    return subs(spark, sf_dir).select("name", substitutions.problem().alias("problem")).where("problem IS NOT NULL")


@query(SUBS + """, a AS (SELECT * FROM s WHERE len(src) > 0), src AS (SELECT o, unnest(src) AS e FROM a), t AS (SELECT o, target AS e FROM a), hy AS (SELECT o, unnest(hyp) AS e FROM a), c AS (
SELECT t.o, t.e, 'target is a source' AS why FROM t WHERE e IN (SELECT e FROM src) UNION SELECT t.o, t.e, 'target in another hypothesis' FROM t JOIN hy ON hy.e = t.e AND hy.o <> t.o
UNION SELECT src.o, src.e, 'source in another hypothesis' FROM src JOIN hy ON hy.e = src.e AND hy.o <> src.o) SELECT o AS name, e AS event, why FROM c""")
def subst_conflicts(spark, sf_dir):
    return substitutions.conflicts(subs(spark, sf_dir))
