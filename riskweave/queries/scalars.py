"""Scalar functions over parts and line items: numeric, Boolean, lifetime laws, domains, deviates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import deviates, intervals, lifetime, numeric
from ..operators import elements
from ..plans import quantify
from . import query, read

apply = numeric.apply
Iv = intervals.Interval


def n9(c, name):
    return F.round(c, 9).alias(name)


def price():
    return F.col("p_retailprice")


def size_():
    return F.col("p_size").cast("double")


@query("""SELECT p_partkey, round(-p_retailprice, 9) AS neg, round(p_retailprice + p_size + 1, 9) AS "add", round(p_retailprice - p_size - 1, 9) AS sub, round(p_retailprice * p_size * 2, 6) AS mul,
round(p_retailprice / p_size / 2, 9) AS div, round(abs(p_size - 25.5), 9) AS abs, round(exp(p_size / 10.0), 6) AS exp, round(ln(p_size), 9) AS log, round(log10(p_size), 9) AS log10,
round(sqrt(p_size), 9) AS sqrt, ceil(p_retailprice)::DOUBLE AS ceil, floor(p_retailprice)::DOUBLE AS floor FROM part""")
def numeric_fns(spark, sf_dir):
    p, s, one, two = price(), size_(), F.lit(1.0), F.lit(2.0)
    return read(spark, sf_dir, "part").select(
        "p_partkey", n9(apply("neg", p), "neg"), n9(apply("add", p, s, one), "add"), n9(apply("sub", p, s, one), "sub"), F.round(apply("mul", p, s, two), 6).alias("mul"), n9(apply("div", p, s, two), "div"),
        n9(apply("abs", s - 25.5), "abs"), F.round(apply("exp", s / 10), 6).alias("exp"), n9(apply("log", s), "log"), n9(apply("log10", s), "log10"), n9(apply("sqrt", s), "sqrt"),
        apply("ceil", p).alias("ceil"), apply("floor", p).alias("floor"),
    )


@query("""SELECT p_partkey, round(cos(p_size), 9) AS cos, round(sin(p_size), 9) AS sin, round(tan(p_size), 6) AS tan, round(acos(p_size / 50.0), 9) AS acos, round(asin(p_size / 50.0), 9) AS asin,
round(atan(p_size), 9) AS atan, round((exp(p_size / 10.0) + exp(-p_size / 10.0)) / 2, 6) AS cosh, round((exp(p_size / 10.0) - exp(-p_size / 10.0)) / 2, 6) AS sinh, round((exp(p_size / 5.0) - 1) / (exp(p_size / 5.0) + 1), 9) AS tanh FROM part""")
def trig_fns(spark, sf_dir):
    s = size_()
    tenth, share = s / 10, s / 50
    return read(spark, sf_dir, "part").select(
        "p_partkey", n9(apply("cos", s), "cos"), n9(apply("sin", s), "sin"), F.round(apply("tan", s), 6).alias("tan"), n9(apply("acos", share), "acos"), n9(apply("asin", share), "asin"), n9(apply("atan", s), "atan"),
        F.round(apply("cosh", tenth), 6).alias("cosh"), F.round(apply("sinh", tenth), 6).alias("sinh"), n9(apply("tanh", tenth), "tanh"),
    )


@query("""SELECT p_partkey, (trunc(p_retailprice)::INT % p_size)::DOUBLE AS "mod", (trunc(-p_retailprice)::INT % 7)::DOUBLE AS mod_negative, round(pow(p_size, 1.5), 6) AS "pow" FROM part""")
def mod_pow(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", apply("mod", price(), size_()).alias("mod"), apply("mod", -price(), F.lit(7.0)).alias("mod_negative"), F.round(apply("pow", size_(), F.lit(1.5)), 6).alias("pow"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, least(l_quantity, l_tax * 100, 30) AS "min", greatest(l_quantity, l_tax * 100, 30) AS "max", round((l_quantity + l_tax * 100 + 30) / 3, 9) AS mean FROM lineitem""")
def min_max_mean(spark, sf_dir):
    q, t, c = F.col("l_quantity"), F.col("l_tax") * 100, F.lit(30.0)
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", apply("min", q, t, c).alias("min"), apply("max", q, t, c).alias("max"), n9(apply("mean", q, t, c), "mean"))


@query("""WITH v AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'NaN'::DOUBLE ELSE p_size END AS x, p_retailprice - 900 AS y FROM part)
SELECT p_partkey, CASE WHEN isnan(x) THEN y ELSE least(x, y) END AS lo, CASE WHEN isnan(x) THEN y ELSE greatest(x, y) END AS hi, CASE WHEN isnan(x) THEN 0.0 ELSE (x = x)::INT::DOUBLE END AS same FROM v""")
def nan_rules(spark, sf_dir):
    """min and max skip NaN; comparisons with it are false."""
    rows = read(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 3 == 0, F.lit(float("nan"))).otherwise(size_()).alias("x"), (price() - 900).alias("y"))
    return rows.select("p_partkey", apply("min", F.col("x"), F.col("y")).alias("lo"), apply("max", F.col("x"), F.col("y")).alias("hi"), apply("eq", F.col("x"), F.col("x")).alias("same"))


@query("""WITH v AS (SELECT p_partkey, (p_size > 25)::INT::DOUBLE AS a, (p_retailprice > 950)::INT::DOUBLE AS b, p_size::DOUBLE AS s FROM part)
SELECT p_partkey, 1 - a AS "not", least(a, b) AS "and", greatest(a, b) AS "or", (s = 10)::INT::DOUBLE AS eq, (s <> 10)::INT::DOUBLE AS df, (s < 10)::INT::DOUBLE AS lt, (s > 10)::INT::DOUBLE AS gt, (s <= 10)::INT::DOUBLE AS leq, (s >= 10)::INT::DOUBLE AS geq FROM v""")
def boolean_fns(spark, sf_dir):
    a, b, s, ten = numeric.number(F.col("p_size") > 25), numeric.number(price() > 950), size_(), F.lit(10.0)
    compare = [apply(op, s, ten).alias(op) for op in ("eq", "df", "lt", "gt", "leq", "geq")]
    return read(spark, sf_dir, "part").select("p_partkey", apply("not", a).alias("not"), apply("and", a, b).alias("and"), apply("or", a, b).alias("or"), *compare)


@query("""SELECT p_partkey, CASE WHEN p_size % 2 <> 0 THEN p_retailprice ELSE 0 END::DOUBLE AS ite, CASE WHEN p_size < 10 THEN 1 WHEN p_size < 30 THEN 2 ELSE 3 END::DOUBLE AS "switch" FROM part""")
def ite_switch(spark, sf_dir):
    s = size_()
    return read(spark, sf_dir, "part").select(
        "p_partkey", apply("ite", s % 2, price(), F.lit(0.0)).alias("ite"),
        apply("switch", apply("lt", s, F.lit(10.0)), F.lit(1.0), apply("lt", s, F.lit(30.0)), F.lit(2.0), F.lit(3.0)).alias("switch"),
    )


@query("""WITH v AS (SELECT p_partkey, p_size - 20.5 AS lo, p_size + 5.5 AS hi FROM part)
SELECT p_partkey, -hi AS neg_lo, -lo AS neg_hi, least(abs(lo), abs(hi)) AS abs_lo, greatest(abs(lo), abs(hi)) AS abs_hi, least(lo * lo, lo * hi, hi * hi) AS mul_lo, greatest(lo * lo, lo * hi, hi * hi) AS mul_hi,
lo - hi AS sub_lo, hi - lo AS sub_hi, (lo + 1) / 2 AS mean_lo, (hi + 2) / 2 AS mean_hi, lo >= 0 AND hi <= 1 AS probability, lo > 0 AS positive FROM v""")
def interval_propagation(spark, sf_dir):
    iv = Iv(size_() - 20.5, size_() + 5.5)
    neg, abs_, mul, sub = (intervals.propagate(op, *a) for op, a in (("neg", [iv]), ("abs", [iv]), ("mul", [iv, iv]), ("sub", [iv, iv])))
    mean = intervals.propagate("mean", iv, Iv.of(1, 2))
    ends = [(f"{n}_{e}", getattr(x, e)) for n, x in (("neg", neg), ("abs", abs_), ("mul", mul), ("sub", sub), ("mean", mean)) for e in ("lo", "hi")]
    return read(spark, sf_dir, "part").select("p_partkey", *[c.alias(n) for n, c in ends], iv.is_probability().alias("probability"), iv.is_positive().alias("positive"))


@query("""WITH v AS (SELECT p_partkey, (p_size - 25)::DOUBLE AS x FROM part), p AS (
SELECT p_partkey, 'div' AS op FROM v WHERE x = 0 UNION ALL SELECT p_partkey, 'acos' FROM v WHERE x / 10 < -1 OR x / 10 > 1 UNION ALL SELECT p_partkey, 'log' FROM v WHERE x <= 0
UNION ALL SELECT p_partkey, 'sqrt' FROM v WHERE x < 0 UNION ALL SELECT p_partkey, 'mod' FROM v WHERE x = 0 UNION ALL SELECT p_partkey, 'pow' FROM v WHERE x = 0)
SELECT op, count(*)::BIGINT AS problems, min(p_partkey) AS first FROM p GROUP BY op""")
def domain_violations(spark, sf_dir):
    """Arguments outside the operators' domains; one pass, all operators at once."""
    x = size_() - 25
    checks = {"div": (F.lit(1.0), x), "acos": (x / 10,), "log": (x,), "sqrt": (x,), "mod": (F.lit(1.0), x), "pow": (x, F.lit(0.0))}
    tried = F.array(*[F.when(numeric.outside_domain(op, *args), op) for op, args in checks.items()])
    rows = read(spark, sf_dir, "part").select("p_partkey", F.explode(F.filter(tried, lambda v: v.isNotNull())).alias("op"))
    return rows.groupBy("op").agg(F.count("*").alias("problems"), F.min("p_partkey").alias("first"))


@query("""SELECT p_partkey, p_retailprice / 1000.0 * 1.05 AS value FROM part WHERE p_retailprice / 1000.0 * 1.05 > 1 OR p_size / 50.0 * 1.1 > 1""")
def probability_violations(spark, sf_dir):
    """Values or domains of probabilities that leave [0, 1]."""
    value, reach = price() / 1000.0 * 1.05, Iv(F.lit(0.0), size_() / 50.0 * 1.1)
    return read(spark, sf_dir, "part").where((value > 1) | ~reach.is_probability()).select("p_partkey", value.alias("value"))


@query("SELECT p_partkey, round(1 - exp(-(p_retailprice * 1e-8) * 8760.0), 9) AS p FROM part")
def exponential(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", n9(lifetime.exponential(price() * 1e-8, F.lit(8760.0)), "p"))


@query("SELECT p_partkey, round((l - (l - 0.01 * (l + 0.1)) * exp(-(l + 0.1) * p_size)) / (l + 0.1), 9) AS p FROM (SELECT *, p_retailprice * 1e-6 AS l FROM part)")
def glm(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", n9(lifetime.glm(F.lit(0.01), price() * 1e-6, F.lit(0.1), size_()), "p"))


@query("SELECT p_partkey, round(CASE WHEN p_size > 10 THEN 1 - exp(-pow((p_size - 10) / 900.0, p_retailprice / 500)) ELSE 0 END, 9) AS p FROM part")
def weibull(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", n9(lifetime.weibull(F.lit(900.0), price() / 500, F.lit(10.0), size_()), "p"))


@query("""SELECT p_partkey, round(CASE WHEN t <= 100 THEN 1 - exp(-1e-4 * t) ELSE 1 - exp(-1e-4 * ((t - 100) - 720 * floor((t - 100) / 720))) END, 9) AS p FROM (SELECT p_partkey, p_retailprice * 9 AS t FROM part)""")
def periodic_test4(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", n9(lifetime.periodic_test_instant(F.lit(1e-4), F.lit(720.0), F.lit(100.0), price() * 9), "p"))


def reached(dt: str) -> str:
    """Of a share in repair, by SQL: working after dt, for the rates l and mu."""
    return f"mu * (exp(-l * {dt}) - exp(-mu * {dt})) / (mu - l)"


@query(f"""WITH RECURSIVE c AS (SELECT p_partkey, p_retailprice::DOUBLE AS t, 1e-4 AS l, 0.02 AS mu, 72.0 AS tau, 10.0 AS theta FROM part),
s AS (
  SELECT *, 0 AS k, exp(-l * least(t, theta)) AS w FROM c
  UNION ALL
  SELECT p_partkey, t, l, mu, tau, theta, k + 1, w * exp(-l * tau) + (1 - w) * {reached("tau")} FROM s WHERE k < floor((t - theta) / tau)
), e AS (SELECT *, t - theta - tau * k AS dt FROM s QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY k DESC) = 1)
SELECT p_partkey, round(CASE WHEN t <= theta THEN 1 - w ELSE 1 - w * exp(-l * dt) - (1 - w) * {reached("dt")} END, 9) AS p FROM e""")
def periodic_test5(spark, sf_dir):
    """Tests that reveal failures with repair times: a recurrence over the tests."""
    return read(spark, sf_dir, "part").select("p_partkey", n9(lifetime.periodic_test_repair(F.lit(1e-4), F.lit(0.02), F.lit(72.0), F.lit(10.0), price()), "p"))


@query(f"""WITH RECURSIVE c AS (SELECT p_partkey, p_retailprice::DOUBLE AS t, 2e-4 AS l, 1e-3 AS lt, 0.02 AS mu, 100.0 AS tau, 30.0 AS theta, 0.01 AS g, 8.0 AS d, 0.95 AS sg, 0.02 AS o FROM part),
s AS (
  SELECT *, 0 AS k, exp(-l * least(t, theta)) AS w, 0.0::DOUBLE AS r FROM c
  UNION ALL
  SELECT p_partkey, t, l, lt, mu, tau, theta, g, d, sg, o, k + 1, w2 * exp(-l * (tau - d)) + (1 - o) * r2 * {reached("(tau - d)")}, r2 * exp(-mu * (tau - d))
  FROM (SELECT *, (1 - o) * r * {reached("d")} + (1 - o) * tw AS w2, r * exp(-mu * d) + sg * (1 - r - tw) AS r2 FROM (SELECT *, (1 - g) * w * exp(-lt * d) AS tw FROM s WHERE k < floor((t - theta) / tau)))
), e AS (SELECT *, t - theta - tau * k AS dt FROM s QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY k DESC) = 1),
x AS (SELECT *, (1 - o) * r * {reached("d")} + (1 - o) * tw AS w2, r * exp(-mu * d) + sg * (1 - r - tw) AS r2 FROM (SELECT *, (1 - g) * w * exp(-lt * d) AS tw FROM e))
SELECT p_partkey, round(CASE WHEN t <= theta THEN 1 - w WHEN dt < d THEN 1 - (1 - o) * r * {reached("dt")} ELSE 1 - w2 * exp(-l * (dt - d)) - (1 - o) * r2 * {reached("(dt - d)")} END, 9) AS p FROM x""")
def periodic_test11(spark, sf_dir):
    """Tests that take time, can break the component and overlook failures; not available under test."""
    values = (2e-4, 1e-3, 0.02, 100.0, 30.0, 0.01, 8.0, 0.0, 0.95, 0.02)
    return read(spark, sf_dir, "part").select("p_partkey", n9(lifetime.periodic_test_full(*map(F.lit, values), price()), "p"))


UNIFORM = "(('0x' || substr(md5('42|' || t || '|' || p_partkey), 1, 8))::BIGINT / 4294967296.0)"
TRIALS = f"WITH v AS (SELECT p_partkey, t, p_size, p_retailprice, {UNIFORM} AS u FROM part, range(20) r(t))"


def sampled(spark, sf_dir):
    return quantify.trials(read(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice"), 20, 42, "p_partkey")


@query(TRIALS + "SELECT p_partkey, round(sum(u), 6) AS total, round(min(p_size + u * 10), 9) AS lo, round(max(p_size + u * 10), 9) AS hi FROM v GROUP BY 1")
def mc_uniform(spark, sf_dir):
    x = deviates.uniform(F.col("u"), size_(), size_() + 10)
    return sampled(spark, sf_dir).groupBy("p_partkey").agg(F.round(F.sum("u"), 6).alias("total"), n9(F.min(x), "lo"), n9(F.max(x), "hi"))


@query(f"""WITH v AS (SELECT p_partkey, t, p_size, {UNIFORM} AS u, (('0x' || substr(md5('42|' || t || '|' || p_partkey || '|2'), 1, 8))::BIGINT / 4294967296.0) AS w FROM part, range(20) r(t))
SELECT p_partkey, round(sum(p_size + 2 * sqrt(-2 * ln(u + 0.5 / 4294967296.0)) * cos(2 * pi() * w)) / 20, 6) AS mean, round(max(exp(0.1 * sqrt(-2 * ln(u + 0.5 / 4294967296.0)) * cos(2 * pi() * w))), 6) AS highest FROM v GROUP BY 1""")
def mc_normal(spark, sf_dir):
    """Normal and lognormal deviates of one keyed draw."""
    rows = sampled(spark, sf_dir).withColumn("w", deviates.keyed_uniform(42, F.col("trial"), F.col("p_partkey"), stream="2"))
    z = deviates.standard_normal(F.col("u"), F.col("w"))
    return rows.groupBy("p_partkey").agg(F.round(F.sum(deviates.normal(z, size_(), F.lit(2.0))) / 20, 6).alias("mean"), F.round(F.max(deviates.lognormal(z, F.lit(0.0), F.lit(0.1))), 6).alias("highest"))


@query(TRIALS + """SELECT t, count(*) FILTER (u < 0.2)::BIGINT AS low, count(*) FILTER (u >= 0.2 AND u < 0.7)::BIGINT AS middle, count(*) FILTER (u >= 0.7)::BIGINT AS high FROM v GROUP BY t""")
def mc_histogram(spark, sf_dir):
    """Draws from a histogram of weights 2, 5, 3 over bounds 0, 1, 2, 3: how many fall in each bin."""
    x = deviates.histogram(F.col("u"), F.lit(0.5), [0.0, 1.0, 2.0, 3.0], [2.0, 5.0, 3.0])
    return sampled(spark, sf_dir).withColumn("x", x).groupBy(F.col("trial").cast("long").alias("t")).agg(F.count_if(F.col("x") < 1).alias("low"), F.count_if((F.col("x") >= 1) & (F.col("x") < 2)).alias("middle"), F.count_if(F.col("x") >= 2).alias("high"))


@query(TRIALS + """, s AS (SELECT t, sum(u * p_size) AS s FROM v GROUP BY t) SELECT round(quantile_cont(s, 0.05), 6) AS q05, round(quantile_cont(s, 0.5), 6) AS q50, round(quantile_cont(s, 0.95), 6) AS q95 FROM s""")
def mc_quantiles(spark, sf_dir):
    sums = sampled(spark, sf_dir).groupBy("trial").agg(F.sum(F.col("u") * F.col("p_size")).alias("s"))
    return sums.agg(*[F.round(F.percentile("s", q), 6).alias(n) for n, q in (("q05", 0.05), ("q50", 0.5), ("q95", 0.95))])


@query(TRIALS + "SELECT least(floor(u / 0.05)::BIGINT + 1, 20) AS bin, count(*)::BIGINT AS n FROM v GROUP BY 1")
def mc_bins(spark, sf_dir):
    return sampled(spark, sf_dir).groupBy(quantify.bins(F.col("u"), 0.0, 1.0, 20).alias("bin")).agg(F.count("*").alias("n"))


@query("""SELECT p_partkey, t, CASE WHEN p < 1e-4 THEN 4 WHEN p < 1e-3 THEN 3 WHEN p < 1e-2 THEN 2 WHEN p < 1e-1 THEN 1 ELSE 0 END AS sil
FROM (SELECT p_partkey, t, 1 - exp(-(p_retailprice * 1e-8) * t) AS p FROM part, (SELECT unnest([0.0, 2000.0, 4000.0, 6000.0, 8000.0, 8760.0])::DOUBLE AS t))""")
def sil_over_time(spark, sf_dir):
    """Integrity levels at every step of the mission."""
    rows = read(spark, sf_dir, "part").withColumn("t", F.explode(quantify.over_time(8760.0, 2000.0)))
    return rows.select("p_partkey", "t", quantify.integrity_level(lifetime.exponential(price() * 1e-8, F.col("t"))).alias("sil"))


@query("SELECT l_returnflag, round(sum(q), 9) AS total, CASE WHEN abs(sum(q) - 1) > 1e-4 THEN 'fractions do not sum to 1' END AS problem FROM (SELECT l_returnflag, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY l_returnflag) * CASE WHEN l_returnflag = 'R' THEN 0.9 ELSE 1 END AS q FROM lineitem GROUP BY l_returnflag, l_linestatus) GROUP BY 1")
def phase_fractions(spark, sf_dir):
    """Line states as phases of each return flag; R's are scaled down, which the rule finds."""
    from ..operators import substitutions

    n = read(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
    total = n.groupBy("l_returnflag").agg(F.sum("n").alias("all"))
    phases = n.join(total, "l_returnflag").select(F.col("l_returnflag").alias("alignment"), F.col("l_linestatus").alias("phase"), (F.col("n").cast("double") / F.col("all") * F.when(F.col("l_returnflag") == "R", 0.9).otherwise(1.0)).alias("fraction"))
    return substitutions.phase_problems(phases).select(F.col("alignment").alias("l_returnflag"), n9(F.col("total"), "total"), "problem")


@query("""WITH s AS (SELECT l_orderkey AS o, array_agg(DISTINCT l_suppkey) AS a, array_agg(DISTINCT l_suppkey) FILTER (l_returnflag <> 'R') AS b FROM lineitem GROUP BY 1)
SELECT o AS l_orderkey, len(a) = len(coalesce(b, [])) AS same FROM s""")
def set_equality(spark, sf_dir):
    """Whether the suppliers of an order are also those of its lines that were not returned, in whatever order."""
    rows = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_suppkey").alias("a"), F.reverse(F.collect_list(F.when(F.col("l_returnflag") != "R", F.col("l_suppkey")))).alias("b"))
    return rows.select("l_orderkey", elements.same_set(F.col("a"), F.col("b")).alias("same"))


TOKENS = """WITH t AS (SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN '-' || p_size WHEN 2 THEN p_size || 'x' WHEN 3 THEN ' ' || p_size WHEN 4 THEN '99999999999' WHEN 5 THEN p_size || '.5' WHEN 6 THEN '' ELSE '+' || p_size END AS i,
CASE p_partkey % 6 WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN '1' WHEN 3 THEN '0' WHEN 4 THEN 'True' ELSE 'yes' END AS b, CASE p_partkey % 3 WHEN 0 THEN '  ' || p_name || ' ' WHEN 1 THEN p_name ELSE chr(9) || p_name END AS n FROM part)"""


@query(TOKENS + """ SELECT p_partkey, CASE WHEN regexp_full_match(i, '[+-]?[0-9]+') THEN TRY_CAST(i AS INTEGER) END AS as_int, CASE WHEN regexp_full_match(i, '[+-]?[0-9]+(\\.[0-9]*)?') THEN TRY_CAST(i AS DOUBLE) END AS as_double,
CASE WHEN b IN ('true', '1') THEN true WHEN b IN ('false', '0') THEN false END AS as_bool, trim(n, ' ') AS name FROM t""")
def strict_casts(spark, sf_dir):
    """Texts as the loader reads them: whole tokens only, no leniency. Numbers with signs, points, spaces, letters, too large or empty."""
    from ..sources.casts import to_bool, to_double, to_int, trim

    key, size, name = F.col("p_partkey"), F.col("p_size").cast("string"), F.col("p_name")
    pick = lambda n, *values: F.element_at(F.array(*values), (key % n + 1).cast("int"))
    i = pick(8, size, F.concat(F.lit("-"), size), F.concat(size, F.lit("x")), F.concat(F.lit(" "), size), F.lit("99999999999"), F.concat(size, F.lit(".5")), F.lit(""), F.concat(F.lit("+"), size))
    b = pick(6, *map(F.lit, ("true", "false", "1", "0", "True", "yes")))
    n = pick(3, F.concat(F.lit("  "), name, F.lit(" ")), name, F.concat(F.lit("\t"), name))
    return read(spark, sf_dir, "part").select("p_partkey", to_int(i).alias("as_int"), to_double(i).alias("as_double"), to_bool(b).alias("as_bool"), trim(n).alias("name"))
