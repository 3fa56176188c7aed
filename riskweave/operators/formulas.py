"""Boolean formulas over gate arguments: truth, probability under independence, arity and nesting rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The connectives with the least and most number of arguments.
CONNECTIVES = {"and": (2, None), "or": (2, None), "atleast": (2, None), "xor": (2, 2), "not": (1, 1), "nand": (2, None), "nor": (2, None), "null": (1, 1), "iff": (2, 2), "imply": (2, 2), "cardinality": (1, None)}


def truth(connective: Column, true: Column, n: Column, first: Column, second: Column, low: Column, high: Column) -> Column:
    """The truth of a gate from the number of its true arguments (each after its complement), and for imply their order."""
    return (
        F.when(connective == "and", true == n)
        .when(connective == "or", true > 0)
        .when(connective == "atleast", true >= low)
        .when(connective == "xor", true == 1)
        .when(connective == "not", true == 0)
        .when(connective == "nand", true < n)
        .when(connective == "nor", true == 0)
        .when(connective == "null", true > 0)
        .when(connective == "iff", true != 1)
        .when(connective == "imply", ~first | second)
        .when(connective == "cardinality", true.between(low, high))
    )


def evaluate(args: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, n, true_args and first/second from args (keys, ordinal, x, complement): one partial aggregation, no sort."""
    x = F.col("x") != F.col("complement")
    return args.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(x).alias("true_args"),
        F.coalesce(F.bool_or(F.when(F.col("ordinal") == 0, x)), F.lit(False)).alias("first"), F.coalesce(F.bool_or(F.when(F.col("ordinal") == 1, x)), F.lit(False)).alias("second"),
    )


def count_distribution(p: Column) -> Column:
    """The distribution of the number of true arguments, from an array of their probabilities, by convolution."""
    start = F.array(F.lit(1.0))
    step = lambda d, q: F.zip_with(
        F.concat(F.transform(d, lambda x: x * (1 - q)), F.array(F.lit(0.0))), F.concat(F.array(F.lit(0.0)), F.transform(d, lambda x: x * q)), lambda a, b: a + b
    )
    return F.aggregate(p, start, step)


def probability(connective: Column, p: Column, low: Column, high: Column) -> Column:
    """P(gate) from the array of its arguments' probabilities, in order and after complements, were they independent."""
    one = F.lit(1.0)
    all_ = F.aggregate(p, one, lambda a, x: a * x)
    none = F.aggregate(p, one, lambda a, x: a * (1 - x))
    d = count_distribution(p)
    between = lambda a, b: F.aggregate(F.filter(F.transform(d, lambda x, i: F.when((i >= a) & (i <= b), x).otherwise(0.0)), lambda x: x > 0), F.lit(0.0), lambda s, x: s + x)
    n = F.size(p)
    return (
        F.when(connective == "and", all_)
        .when(connective.isin("or", "null"), 1 - none)
        .when(connective == "atleast", between(low, n))
        .when(connective == "xor", between(F.lit(1), F.lit(1)))
        .when(connective.isin("not", "nor"), none)
        .when(connective == "nand", 1 - all_)
        .when(connective == "iff", 1 - between(F.lit(1), F.lit(1)))
        .when(connective == "imply", 1 - F.get(p, F.lit(0)) * (1 - F.get(p, F.lit(1))))
        .when(connective == "cardinality", between(low, high))
    )


def arity_problem(connective: Column, n: Column, low: Column, high: Column) -> Column:
    """What is wrong with the numbers of a formula; null if nothing."""
    many, one, two = connective.isin("and", "or", "nand", "nor"), connective.isin("not", "null"), connective.isin("xor", "iff", "imply")
    limits = connective.isin("atleast", "cardinality")
    return (
        F.when(~connective.isin(*CONNECTIVES), "unknown connective")
        .when((low < 0) | (high < 0), "negative number")
        .when((low.isNotNull() & ~limits) | (high.isNotNull() & (connective != "cardinality")), "number without use")
        .when(many & (n < 2), "needs 2 or more arguments")
        .when(one & (n != 1), "needs 1 argument")
        .when(two & (n != 2), "needs 2 arguments")
        .when((connective == "atleast") & (low.isNull() | (low < 2)), "min number must be 2 or more")
        .when((connective == "atleast") & (n <= low), "needs more arguments than its min number")
        .when((connective == "cardinality") & (low.isNull() | high.isNull()), "needs min and max numbers")
        .when((connective == "cardinality") & (low > high), "min number above max number")
        .when((connective == "cardinality") & (n < 1), "needs arguments")
        .when((connective == "cardinality") & (high > n), "max number above number of arguments")
    )


def nesting_problem(connective: Column, complement: Column, constant: Column) -> Column:
    """not and null take no complement, not takes no constant."""
    return F.when(connective.isin("not", "null") & complement, "complement of a single argument").when((connective == "not") & constant, "complement of a constant")


def duplicate_args(args: DataFrame, gate: str = "gate_id", arg: str = "arg_id") -> DataFrame:
    """Arguments that a gate has more than once, complemented or not."""
    return args.groupBy(gate, arg).agg(F.count("*").alias("n")).where("n > 1")


def swap_args(args: DataFrame, new: Column) -> DataFrame:
    """Another event in the place of each argument (``new``, in terms of arg_id); ordinal and complement stay."""
    return args.withColumn("arg_id", new)


def remove_args(args: DataFrame, gone: DataFrame, gate: str = "gate_id", arg: str = "arg_id") -> DataFrame:
    """Arguments without those of ``gone`` (gate, arg); the others keep their order, numbered anew without gaps."""
    left = args.join(gone.select(gate, arg), [gate, arg], "left_anti")
    return left.withColumn("ordinal", F.row_number().over(Window.partitionBy(gate).orderBy("ordinal")) - 1)


def replace_formulas(gates: DataFrame, args: DataFrame, new_gates: DataFrame, new_args: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(gates, args, old gates, old args): the formulas of ``new_gates`` (id, ...) instead of those that the gates had, which come back."""
    ids, owners = new_gates.select("id"), new_gates.select(F.col("id").alias("gate_id"))
    there, theirs = new_gates.join(gates.select("id"), "id", "left_semi"), new_args.join(gates.select(F.col("id").alias("gate_id")), "gate_id", "left_semi")
    return (
        gates.join(ids, "id", "left_anti").unionByName(there), args.join(owners, "gate_id", "left_anti").unionByName(theirs.join(owners, "gate_id", "left_semi")),
        gates.join(ids, "id", "left_semi"), args.join(owners, "gate_id", "left_semi"),
    )
