"""Quality rules under weak supervision, in DataFrame functions only.

Every rule votes good (1), bad (-1) or abstains (0). How often each combination of votes occurs over all documents is
counted (at most 3 ** rules rows, however many documents there are), expectation-maximisation over these counts
estimates each rule's accuracies without any label, and a document is kept by its posterior probability of being good.

Null texts have no words; every count is then 0 and the base rules fail. Repeated rows get equal results. Only the key
and the text are read, so other columns may have any name. An empty table gives an empty table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, WORD_GAP, Scratch, table

SYMBOLS = "#*$%&|<>"

#: name -> (column that falls when the text is good, good at or below, bad at or above); between the two a rule abstains.
RULES = {
    "symbol_chars": ("symbol_rate", 0.01, 0.03),
    "symbol_words": ("symbols_a_word", 0.03, 0.1),
    "symbol_lines": ("symbol_line_rate", 0.2, 0.6),
    "long_words": ("mean_word", 8.5, 12.0),
    "short_words": ("short_mean", -3.0, -2.2),
    "dup_lines": ("dup_line_rate", 0.3, 0.6),
    "repeats": ("repeat_rate", 0.3, 0.5),
    "digits": ("digit_rate", 0.05, 0.2),
    "vocabulary": ("same_word_rate", 0.75, 0.9),
}


def measures(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The counts that the rules read, one row for each row of ``df``, from the whole text and without a shuffle."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    df = df.select(F.col(key).alias("_key"), t.alias("_t"))
    df = df.withColumn("_w", F.filter(F.split("_t", WORD_GAP), lambda w: w != ""))
    df = df.withColumn("_n", F.size("_w"))
    # 3-word windows as (hash, position), sorted: equal windows stand side by side
    windows = F.expr("transform(sequence(0, _n - 3), i -> struct(xxhash64(_w[i], _w[i + 1], _w[i + 2]) AS h, i AS i))")
    df = df.withColumn("_s", F.when(F.col("_n") > 3, F.sort_array(windows)))
    # positions of windows found twice or more
    again = F.expr(
        "sort_array(transform(filter(sequence(0, size(_s) - 1), j -> (j > 0 AND _s[j].h = _s[greatest(j - 1, 0)].h)"
        " OR (j < size(_s) - 1 AND _s[j].h = _s[least(j + 1, size(_s) - 1)].h)), j -> _s[j].i))"
    )
    df = df.withColumn("_p", F.when(F.col("_s").isNotNull(), again))
    # each such window covers 3 words, less what the next one covers as well
    covered = F.expr("aggregate(_p, struct(0L AS n, -3 AS last), (a, p) -> struct(a.n + least(3, p - a.last) AS n, p AS last), a -> a.n)")
    lines = F.filter(F.split("_t", "\n"), lambda x: F.length(F.translate(x, SPACE, "")) > 0)
    df = df.withColumn("_l", lines)
    return df.select(
        F.col("_key").alias(key),
        F.col("_n").cast("long").alias("n_words"),
        F.length(F.translate("_t", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
        F.size(F.filter("_l", lambda x: F.length(F.translate(x, SYMBOLS, "")) < F.length(x))).cast("long").alias("n_symbol_lines"),
        (F.length("_t") - F.length(F.translate("_t", "0123456789", ""))).cast("long").alias("n_digits"),
        F.size(F.array_distinct("_w")).cast("long").alias("n_distinct"),
    )


def votes(df: DataFrame, rules: dict = RULES) -> DataFrame:
    """``measures`` with a vote_<rule> column (1, -1 or 0) for each rule; texts without a word abstain everywhere."""
    words = F.greatest("n_words", F.lit(1))
    rates = {
        "symbol_rate": F.col("n_symbols") / F.greatest("word_chars", F.lit(1)),
        "symbols_a_word": F.col("n_symbols") / words,
        "symbol_line_rate": F.col("n_symbol_lines") / F.greatest("n_lines", F.lit(1)),
        "mean_word": F.col("word_chars") / words,
        "short_mean": -F.col("word_chars") / words,
        "dup_line_rate": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
        "repeat_rate": F.col("n_repeat_words") / words,
        "digit_rate": F.col("n_digits") / F.greatest("word_chars", F.lit(1)),
        "same_word_rate": 1 - F.col("n_distinct") / words,
    }
    for name, (rate, good, bad) in rules.items():
        vote = F.when(F.col("n_words") == 0, 0).when(rates[rate] <= good, 1).when(rates[rate] >= bad, -1).otherwise(0)
        df = df.withColumn(f"vote_{name}", vote.cast("int"))
    return df


@dataclass(frozen=True)
class LabelModel:
    """Class prior and, for each rule and class, the probabilities of the votes."""

    prior: float
    chance: dict[str, dict[int, dict[int, float]]]

    def posterior(self) -> Column:
        """P(good | votes) as a column of the vote columns."""
        odds = F.lit(math.log(self.prior / (1 - self.prior)))
        for name, by_class in self.chance.items():
            v = F.col(f"vote_{name}")
            gain = {x: math.log(by_class[1][x] / by_class[0][x]) for x in (-1, 0, 1)}
            odds = odds + F.when(v == 1, gain[1]).when(v == -1, gain[-1]).otherwise(gain[0])
        return 1 / (1 + F.exp(-odds))


#: Where expectation-maximisation starts: a bad document still passes most rules, a good one seldom fails any.
START = {1: {1: 0.78, 0: 0.2, -1: 0.02}, 0: {1: 0.65, 0: 0.15, -1: 0.2}}


def fit(voted: DataFrame, rules: dict = RULES, steps: int = 60, prior: float = 0.8) -> LabelModel:
    """Expectation-maximisation over the counted vote combinations of all documents.

    A rule's votes keep the side on which they start: a good vote never counts for bad. Smoothing by one
    pseudo-document for each vote keeps every probability off 0 and 1.
    """
    names = list(rules)
    cells = voted.groupBy(*[f"vote_{n}" for n in names]).count().collect()  # at most 3 ** len(rules) rows
    data = sorted(([r[i] for i in range(len(names))], r["count"]) for r in cells)
    total = sum(n for _, n in data) or 1
    chance = {n: {c: dict(START[c]) for c in START} for n in names}
    for _ in range(steps if data else 0):
        sums = {n: {c: {v: 1.0 for v in (-1, 0, 1)} for c in (0, 1)} for n in names}
        good = 0.0
        for vote, n in data:
            odds = math.log(prior / (1 - prior)) + sum(math.log(chance[k][1][v] / chance[k][0][v]) for k, v in zip(names, vote, strict=True))
            p = 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))
            good += n * p
            for k, v in zip(names, vote, strict=True):
                sums[k][1][v] += n * p
                sums[k][0][v] += n * (1 - p)
        prior = min(0.99, max(0.5, good / total))
        for k in names:
            for c in (0, 1):
                whole = sum(sums[k][c].values())
                chance[k][c] = {v: s / whole for v, s in sums[k][c].items()}
            for v in (1, -1):  # keep the side
                hi, lo = (1, 0) if v == 1 else (0, 1)
                if chance[k][hi][v] < chance[k][lo][v]:
                    chance[k][hi][v] = chance[k][lo][v] = (chance[k][hi][v] + chance[k][lo][v]) / 2
    return LabelModel(prior, chance)


def judge(df: DataFrame, key: str = "doc_id", text: str = "text", rules: dict = RULES, threshold: float = 0.5) -> DataFrame:
    """Measures, votes, ``p_good``, ``base_failed`` and ``kept`` for every row of ``df``.

    The measures (some numbers a document) are written once to the shared folder: the fit and the result read them.
    """
    scratch = Scratch(df.sparkSession, "quality")
    voted = scratch.save(votes(measures(df, key, text), rules), "votes")
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    model = fit(voted.where(~base), rules)  # what the base rules reject needs no verdict and would shape the bad class
    out = voted.withColumn("p_good", model.posterior()).withColumn("base_failed", base)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good"]
    return judge(table(spark, sf_dir, "documents")).select(*columns)
