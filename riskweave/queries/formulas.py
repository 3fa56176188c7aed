"""Gates over orders and line items: connectives, probabilities, rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lifetime
from ..operators import elements, formulas, graphs
from ..plans import quantify
from . import query, read

RATE, HOURS = 1e-8, 8760.0


def part_probability():
    """A basic event per part: exponential, with the price as rate."""
    return lifetime.exponential(F.col("p_retailprice") * RATE, F.lit(HOURS))


def gate_args(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gate, arg): distinct parts of each order."""
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("gate"), F.col("l_partkey").alias("arg")).distinct()


def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gate, n, connective, p_all, p_none): AND over an even number of arguments, else OR."""
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("arg"), part_probability().alias("p"))
    rows = gate_args(spark, sf_dir).join(p, "arg").groupBy("gate").agg(F.count("*").alias("n"), F.product("p").alias("p_all"), F.product(1 - F.col("p")).alias("p_none"))
    return rows.withColumn("connective", F.when(F.col("n") % 2 == 0, "and").otherwise("or"))


GATES = """
WITH a AS (SELECT DISTINCT l_orderkey AS gate, l_partkey AS arg FROM lineitem),
e AS (SELECT p_partkey AS arg, 1 - exp(-(p_retailprice * 1e-8) * 8760.0) AS p FROM part),
g AS (SELECT gate, count(*) AS n, product(p) AS p_all, product(1 - p) AS p_none FROM a JOIN e USING (arg) GROUP BY gate),
q AS (SELECT gate, n, CASE WHEN n % 2 = 0 THEN p_all ELSE 1 - p_none END AS p FROM g)
"""


@query(GATES + "SELECT o_orderpriority, count(*)::BIGINT AS gates, round(sum(p), 6) AS sum_p FROM q JOIN orders ON o_orderkey = gate GROUP BY o_orderpriority")
def gate_prob_by_priority(spark, sf_dir):
    """Gate probabilities of all orders, by priority."""
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("gate"), "o_orderpriority")
    p = F.when(F.col("connective") == "and", F.col("p_all")).otherwise(1 - F.col("p_none"))
    return gates(spark, sf_dir).join(orders, "gate").groupBy("o_orderpriority").agg(F.count("*").alias("gates"), F.round(F.sum(p), 6).alias("sum_p"))


def returned_args(spark, sf_dir) -> DataFrame:
    """Line items as arguments: true if returned; complemented if the quantity is odd; ordinal by a total order."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    rows = read(spark, sf_dir, "lineitem").withColumn("ordinal", F.row_number().over(order) - 1)
    return rows.select(F.col("l_orderkey").alias("gate"), "ordinal", (F.col("l_returnflag") == "R").alias("x"), (F.col("l_quantity") % 2 == 1).alias("complement"))


ARGS = """
WITH a AS (SELECT l_orderkey AS gate, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 AS ordinal,
  (l_returnflag = 'R') <> (l_quantity % 2 = 1) AS x FROM lineitem),
g AS (SELECT gate, count(*) AS n, count(*) FILTER (x) AS t, coalesce(bool_or(x) FILTER (ordinal = 0), false) AS f, coalesce(bool_or(x) FILTER (ordinal = 1), false) AS s FROM a GROUP BY gate)
"""
SIMPLE = ("and", "or", "not", "nand", "nor", "null", "xor", "iff", "imply")


@query(ARGS + """SELECT gate, n::BIGINT AS n, t = n AS c_and, t > 0 AS c_or, t = 0 AS c_not, t < n AS c_nand, t = 0 AS c_nor, t > 0 AS c_null, t = 1 AS c_xor, t <> 1 AS c_iff, (NOT f) OR s AS c_imply FROM g""")
def connectives_truth(spark, sf_dir):
    """Nine connectives over every order's line items, in one aggregation."""
    g = formulas.evaluate(returned_args(spark, sf_dir), ["gate"])
    value = lambda c: formulas.truth(F.lit(c), F.col("true_args"), F.col("n"), F.col("first"), F.col("second"), F.lit(None), F.lit(None))
    return g.select("gate", "n", *[value(c).alias(f"c_{c}") for c in SIMPLE])


@query(ARGS + "SELECT gate, t >= 2 AS at_least_2, t >= 3 AS at_least_3 FROM g WHERE n > 2")
def atleast_k(spark, sf_dir):
    g = formulas.evaluate(returned_args(spark, sf_dir), ["gate"]).where("n > 2")
    value = lambda k: formulas.truth(F.lit("atleast"), F.col("true_args"), F.col("n"), F.col("first"), F.col("second"), F.lit(k), F.lit(None))
    return g.select("gate", value(2).alias("at_least_2"), value(3).alias("at_least_3"))


@query(ARGS + "SELECT t BETWEEN 1 AND 2 AS in_range, count(*)::BIGINT AS gates FROM g GROUP BY 1")
def cardinality_range(spark, sf_dir):
    g = formulas.evaluate(returned_args(spark, sf_dir), ["gate"])
    value = formulas.truth(F.lit("cardinality"), F.col("true_args"), F.col("n"), F.col("first"), F.col("second"), F.lit(1), F.lit(2))
    return g.groupBy(value.alias("in_range")).agg(F.count("*").alias("gates"))


@query("SELECT l_orderkey AS gate_id, l_partkey AS arg_id, count(*)::BIGINT AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def arg_duplicates(spark, sf_dir):
    return formulas.duplicate_args(read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("gate_id"), F.col("l_partkey").alias("arg_id")))


@query("""WITH a AS (SELECT DISTINCT l_orderkey AS gate, l_partkey AS arg FROM lineitem), g AS (SELECT gate, count(*) AS n FROM a GROUP BY gate),
c AS (SELECT gate, n, CASE gate % 6 WHEN 0 THEN 'and' WHEN 1 THEN 'xor' WHEN 2 THEN 'not' WHEN 3 THEN 'atleast' WHEN 4 THEN 'cardinality' ELSE 'or' END AS c FROM g),
p AS (SELECT gate, c AS connective, CASE WHEN c IN ('and', 'or') AND n < 2 THEN 'needs 2 or more arguments' WHEN c = 'not' AND n <> 1 THEN 'needs 1 argument' WHEN c = 'xor' AND n <> 2 THEN 'needs 2 arguments'
 WHEN c = 'atleast' AND n <= 2 THEN 'needs more arguments than its min number' WHEN c = 'cardinality' AND 3 > n THEN 'max number above number of arguments' END AS problem FROM c)
SELECT gate, connective, problem FROM p WHERE problem IS NOT NULL""")
def formula_arity_violations(spark, sf_dir):
    """Connectives dealt out by order key; those that the number of arguments breaks."""
    g = gate_args(spark, sf_dir).groupBy("gate").agg(F.count("*").alias("n"))
    kinds = F.array(*map(F.lit, ("and", "xor", "not", "atleast", "cardinality", "or")))
    g = g.withColumn("connective", F.get(kinds, (F.col("gate") % 6).cast("int")))
    low = F.when(F.col("connective") == "atleast", 2).when(F.col("connective") == "cardinality", 1)
    high = F.when(F.col("connective") == "cardinality", 3)
    return g.select("gate", "connective", formulas.arity_problem(F.col("connective"), F.col("n"), low, high).alias("problem")).where("problem IS NOT NULL")


@query("""SELECT l_orderkey AS gate, l_linenumber AS line, CASE WHEN l_quantity % 2 = 1 THEN 'complement of a single argument' WHEN l_returnflag = 'N' THEN 'complement of a constant' END AS problem
FROM lineitem WHERE l_quantity % 2 = 1 OR l_returnflag = 'N'""")
def formula_nesting(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem")
    problem = formulas.nesting_problem(F.lit("not"), F.col("l_quantity") % 2 == 1, F.col("l_returnflag") == "N")
    return rows.select(F.col("l_orderkey").alias("gate"), F.col("l_linenumber").alias("line"), problem.alias("problem")).where("problem IS NOT NULL")


@query("""WITH a AS (SELECT DISTINCT l_orderkey AS gate, l_partkey AS arg FROM lineitem)
SELECT gate, arg - arg % 2 AS arg_id, count(*)::BIGINT AS n FROM a GROUP BY 1, 2 HAVING count(*) > 1""")
def swap_duplicates(spark, sf_dir):
    """Every odd event replaced by the even one before it: gates that then have one twice."""
    args = gate_args(spark, sf_dir).withColumnRenamed("arg", "arg_id")
    return formulas.duplicate_args(formulas.swap_args(args, F.col("arg_id") - F.col("arg_id") % 2), "gate")


@query(ARGS + """, d AS (SELECT gate, n FROM g) SELECT d.gate, d.n::BIGINT AS n,
round(1 - pow(0.9, n), 9) AS p_or, round(pow(0.1, n), 12) AS p_and, round(n * 0.1 * pow(0.9, n - 1), 9) AS p_one, abs(round(1 - pow(0.9, n) - n * 0.1 * pow(0.9, n - 1), 9)) AS p_two FROM d""")
def vote_probability(spark, sf_dir):
    """Count distributions by convolution, for gates of equal arguments (p = 0.1)."""
    g = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("gate")).agg(F.count("*").alias("n"))
    p = F.array_repeat(F.lit(0.1), F.col("n").cast("int"))
    value = lambda c, low=None, high=None: formulas.probability(F.lit(c), p, F.lit(low), F.lit(high))
    return g.select("gate", "n", F.round(value("or"), 9).alias("p_or"), F.round(value("and"), 12).alias("p_and"), F.round(value("cardinality", 1, 1), 9).alias("p_one"), F.abs(F.round(value("atleast", 2), 9)).alias("p_two"))


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)")
def unused_events(spark, sf_dir):
    """Parts that no line of the largest quantities refers to."""
    refs = read(spark, sf_dir, "lineitem").where("l_quantity > 48")
    return elements.unused(read(spark, sf_dir, "part").select("p_partkey", "p_name"), refs, "p_partkey", "l_partkey")


@query("SELECT c_mktsegment, count(*)::BIGINT AS used FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) GROUP BY 1")
def used_events(spark, sf_dir):
    found = elements.used(read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders"), "c_custkey", "o_custkey")
    return found.groupBy("c_mktsegment").agg(F.count("*").alias("used"))


@query("""SELECT DISTINCT o_orderstatus AS tree, o_orderkey AS gate_id FROM orders o WHERE NOT EXISTS
(SELECT 1 FROM orders p WHERE p.o_orderstatus = o.o_orderstatus AND p.o_orderkey * 2 + 1 = o.o_orderkey)""")
def top_events(spark, sf_dir):
    """Orders as gates, key k referring to 2k + 1 of the same status: those that none refers to."""
    orders = read(spark, sf_dir, "orders")
    nodes = orders.select(F.col("o_orderstatus").alias("tree"), F.col("o_orderkey").alias("gate_id")).distinct()
    args = orders.select(F.col("o_orderstatus").alias("tree"), (F.col("o_orderkey") * 2 + 1).alias("arg_id"))
    return graphs.top_nodes(nodes, args)


@query(GATES + "SELECT o_orderpriority, round(least(sum(p), 1e9), 6) AS rare_event FROM q JOIN orders ON o_orderkey = gate GROUP BY o_orderpriority")
def rare_event(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("gate"), "o_orderpriority")
    p = F.when(F.col("connective") == "and", F.col("p_all")).otherwise(1 - F.col("p_none"))
    return gates(spark, sf_dir).withColumn("p", p).join(orders, "gate").groupBy("o_orderpriority").agg(F.round(quantify.rare_event(F.col("p"), cap=1e9), 6).alias("rare_event"))


@query("""WITH a AS (SELECT DISTINCT l_orderkey AS gate, l_partkey AS arg FROM lineitem), e AS (SELECT p_partkey AS arg, 1 - exp(-(p_retailprice * 1e-8) * 8760.0) AS p FROM part),
c AS (SELECT gate, product(p) AS p FROM a JOIN e USING (arg) GROUP BY gate) SELECT o_orderpriority, round(1 - exp(sum(ln(1 - p))), 9) AS mcub FROM c JOIN orders ON o_orderkey = gate GROUP BY 1""")
def mcub(spark, sf_dir):
    """Minimal-cut upper bound, every order being a cut set of its parts."""
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("gate"), "o_orderpriority")
    return gates(spark, sf_dir).join(orders, "gate").groupBy("o_orderpriority").agg(F.round(quantify.mcub(F.col("p_all")), 9).alias("mcub"))


@query("""WITH a AS (SELECT DISTINCT l_orderkey AS gate, l_partkey AS arg FROM lineitem), e AS (SELECT p_partkey AS arg, 1 - exp(-(p_retailprice * 1e-8) * 8760.0) AS p FROM part),
c AS (SELECT gate, product(p) AS p FROM a JOIN e USING (arg) GROUP BY gate), t AS (SELECT sum(p) AS total FROM c)
SELECT arg, count(*)::BIGINT AS cuts, round(sum(c.p) / max(t.total), 9) AS fussell_vesely FROM a JOIN c USING (gate), t GROUP BY arg""")
def importance(spark, sf_dir):
    """Fussell-Vesely importance of every part, the orders being cut sets."""
    cuts = gate_args(spark, sf_dir)
    p = gates(spark, sf_dir).select("gate", F.col("p_all").alias("p"))
    return quantify.fussell_vesely(cuts, p).withColumn("fussell_vesely", F.round("fussell_vesely", 9))


def class_gates(spark, sf_dir, n):
    """(tops, args): each order is an AND of an OR for each of the ``n`` classes of suppliers that it has, over its parts.

    Ids are numbers: an order's is 2n times its key, those of its classes come after it.
    """
    order = F.col("l_orderkey") * (2 * n)
    rows = read(spark, sf_dir, "lineitem").select(order.alias("root"), F.col("l_partkey").alias("arg"), (order + F.col("l_suppkey") % n + n).alias("side"))
    ands = rows.select(F.col("root").alias("gate"), F.lit("and").alias("connective"), F.col("side").alias("arg"), F.lit(True).alias("is_gate"))
    ors = rows.select(F.col("side").alias("gate"), F.lit("or").alias("connective"), "arg", F.lit(False).alias("is_gate")).distinct()
    return rows.select(F.col("root").alias("gate")), ands.unionByName(ors)  # repeated tops and arguments of ANDs are one when sets are made


def _order(n: int):
    """The key of an order of ``class_gates``."""
    return F.expr(f"root div {2 * n}").alias("root")


@query("""WITH s AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p, l_suppkey % 3 AS k FROM lineitem),
c AS (SELECT DISTINCT o, list_sort(list_distinct([a.p, b.p, c.p])) AS cut FROM (SELECT DISTINCT o FROM s) LEFT JOIN (FROM s WHERE k = 0) a USING (o) LEFT JOIN (FROM s WHERE k = 1) b USING (o) LEFT JOIN (FROM s WHERE k = 2) c USING (o))
SELECT o AS root, array_to_string(cut, ' ') AS cut FROM c""")
def cutset_expand(spark, sf_dir):
    """Orders over three classes of suppliers: all sets that expanding gates gives, before absorption."""
    cuts = quantify.cut_sets(*class_gates(spark, sf_dir, 3), limit_order=20, absorb=False)
    return cuts.select(_order(3), F.array_join(F.col("cut").cast("array<string>"), " ").alias("cut"))


@query("""WITH s AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p, l_suppkey % 2 AS k FROM lineitem), n AS (SELECT o, count(DISTINCT k) AS ks FROM s GROUP BY o),
c AS (SELECT DISTINCT a.o, least(a.p, b.p) AS first, greatest(a.p, b.p) AS second FROM s a JOIN s b ON a.o = b.o AND a.k = 0 AND b.k = 1 UNION SELECT s.o, p, p FROM s JOIN n USING (o) WHERE ks = 1)
SELECT o AS root, first, second FROM c WHERE first = second OR NOT EXISTS (SELECT 1 FROM c d WHERE d.o = c.o AND d.first = d.second AND (d.first = c.first OR d.first = c.second))""")
def cutset_minimal(spark, sf_dir):
    """Orders over two classes of suppliers: the minimal cut sets."""
    cuts = quantify.cut_sets(*class_gates(spark, sf_dir, 2), limit_order=20)
    return cuts.select(_order(2), F.element_at("cut", 1).alias("first"), F.element_at("cut", -1).alias("second"))
