"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context windows around what they find.

The lexicon holds whole words and stems. Some common English insults are given; the rest is learned from labelled
documents: prefixes and words that stand nearly only in toxic ones. Words of texts run through one automaton, the
intersection of the lexicon trie with the Levenshtein automata of its words and longer stems, determinised as needed; it accepts a word
within one edit of a term, or with a beginning within one edit of a stem. Each hit is looked at in its window: quotation marks or reporting verbs speak for a
quotation, second-person words for abuse. A logistic regression turns the sums into a score.

Lexicon and regression are fitted on at most ``max_labelled`` labelled documents (a documented bound); every document
is scored by its whole text. Null and empty texts have no hits and get the score of a text without hits. Labels that
are null are not learned from; a label that occurs with both values for one document counts as toxic. Without any
labels of either kind the given insults alone decide. Repeated rows get equal scores; empty tables give empty tables.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

INSULTS = ("idiot", "moron", "stupid", "loser", "pathetic", "worthless", "scum", "trash", "clown", "disgusting", "imbecile", "bastard", "asshole", "bitch", "dumbass", "retard", "scumbag", "vermin", "subhuman", "whore")
YOU = frozenset("you your yours you're yourself u ya thou tu te toi vous votre ton ta tes du dich dir dein deine ihr euch usted ustedes ti vos vosotros su".split())
REPORTS = frozenset("said says wrote writes quoted quote called reported replied claims tweeted dit disait écrit sagte schrieb meinte zitat dijo escribió decía cita".split())
QUOTES = frozenset("\"“”„«»‘’‹›")
EDGE = ".,;:!?|()[]{}<>*#$%&\"'“”„«»‘’‹›…-_/\\"
STEMS = range(4, 9)  # lengths of learned stems
NEAR_STEM = 6  # letters of a stem that also counts within one edit, at least
WINDOW = 8
#: A worker forgets its memo of words beyond this number; results do not depend on it.
MEMO = 300_000
FEATURES = 6


class Automaton:
    """The lexicon trie intersected with Levenshtein automata of ``edits`` edits, determinised state by state.

    Of ``stems`` any continuation is accepted: a word matches once a prefix of it is within the edits of a stem.
    """

    def __init__(self, words: list[str], edits: int = 1, stems: list[str] = ()):
        self.children: list[dict[str, int]] = [{}]
        self.ends, self.stem_ends = {self._add(w) for w in words}, {self._add(w) for w in stems}
        self.edits = edits
        self.longest = max(map(len, words), default=0) + edits
        self.known: dict[frozenset, int] = {}
        self.moves: list[dict[str, int]] = []
        self.accepts: list[bool] = []
        self.sets: list[frozenset] = []
        self.stops: list[bool] = []  # nothing that follows matters
        self.start = self._state({(0, 0)})

    def _add(self, word: str) -> int:
        node = 0
        for c in word:
            if c not in self.children[node]:
                self.children[node][c] = len(self.children)
                self.children.append({})
            node = self.children[node][c]
        return node

    def _state(self, items: set[tuple[int, int]]) -> int:
        todo, closed = list(items), set(items)
        while todo:  # a letter of the term that the word leaves out
            node, e = todo.pop()
            if e < self.edits:
                for child in self.children[node].values():
                    if (child, e + 1) not in closed:
                        closed.add((child, e + 1))
                        todo.append((child, e + 1))
        key = frozenset(closed)
        if key not in self.known:
            self.known[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            self.stops.append(any(node in self.stem_ends for node, _ in key))
            self.accepts.append(self.stops[-1] or any(node in self.ends for node, _ in key))
        return self.known[key]

    def _move(self, state: int, c: str) -> int:
        out = set()
        for node, e in self.sets[state]:
            if c in self.children[node]:
                out.add((self.children[node][c], e))
            if e < self.edits:
                out.add((node, e + 1))  # a letter too many
                out.update((child, e + 1) for child in self.children[node].values())  # another letter
        target = self._state(out) if out else -1
        self.moves[state][c] = target
        return target

    def match(self, word: str) -> bool:
        if len(word) > self.longest and not self.stem_ends:
            return False
        state = self.start
        for c in word:
            if self.stops[state]:
                return True
            target = self.moves[state].get(c)
            if target is None:
                target = self._move(state, c)
            if target < 0:
                return False
            state = target
        return self.accepts[state]


@dataclass
class Lexicon:
    words: dict[str, float]  # term -> log-odds of toxic documents
    stems: dict[str, float]
    automaton: Automaton = field(init=False)
    memo: dict = field(init=False, default_factory=dict)

    def __post_init__(self):
        # a short word has too many neighbours within one edit, a short stem many more
        self.automaton = Automaton(sorted(w for w in self.words if len(w) >= 5), 1, sorted(w for w in self.stems if len(w) >= NEAR_STEM))

    def kind(self, token: str) -> float:
        """The log-odds of a term or of a word with a learned stem; -1 within an edit of a term; 0 for any other."""
        found = self.memo.get(token)
        if found is None:
            word = token.strip(EDGE)
            found = self.words.get(word) or max((self.stems.get(word[:k], 0.0) for k in STEMS if len(word) >= k), default=0.0)
            if not found and len(word) >= 4 and self.automaton.match(word):
                found = -1.0
            if len(self.memo) > MEMO:
                self.memo.clear()
            if len(token) <= 40:
                self.memo[token] = found
        return found

    def features(self, text: str | None) -> list[float]:
        tokens = (text or "").lower().split()
        kind = self.kind
        hot = {t: k for t in set(tokens) if (k := kind(t))}
        if not hot:
            return [0.0] * FEATURES
        exact = near = quoted = direct = most = total = 0.0
        for i, t in enumerate(tokens):
            if t in hot:
                k = hot[t]
                around = tokens[max(0, i - WINDOW) : i + WINDOW + 1]
                told = any(x.strip(EDGE) in REPORTS for x in around) or sum(not QUOTES.isdisjoint(x) for x in around) >= 2
                exact += k > 0
                near += k < 0
                most, total = max(most, k), total + max(k, 0.0)
                quoted += told
                direct += not told and any(x.strip(EDGE) in YOU for x in around)
        n = exact + near
        return [most, math.log1p(exact), math.log1p(near), quoted / n, direct / n, math.log1p(total)]


@dataclass
class Model:
    words: dict[str, float]
    stems: dict[str, float]
    weights: np.ndarray  # the last is the intercept

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def held_out(key: str):
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, toxic, context, documents): stems and ``word$`` of labelled documents; clean ones without contexts."""
    for batch in batches:
        clean: Counter = Counter()
        toxic: Counter = Counter()
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            tokens = [t.strip(EDGE) for t in (text or "").lower().split()]
            if not label:
                words = {t for t in tokens if 4 <= len(t) <= 40}
                terms = {w[:k] for w in words for k in STEMS if len(w) >= k}
                clean.update(terms)
                clean.update(w + "$" for w in words)
                continue
            seen = set()
            for i, w in enumerate(tokens):
                if 4 <= len(w) <= 40 and w not in seen:
                    seen.add(w)
                    # copies of one text count once: they show the term between the same words
                    context = f"{tokens[i - 1] if i else ''} {tokens[i + 1] if i + 1 < len(tokens) else ''}"
                    toxic.update((t, context) for t in {*(w[:k] for k in STEMS if len(w) >= k), w + "$"})
        rows = [(t, None, n) for t, n in clean.items()] + [(t, c, n) for (t, c), n in toxic.items()]
        for at in range(0, len(rows), 100_000):
            part = rows[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.string()), pa.array([r[1] for r in part], pa.string()), pa.array([r[2] for r in part], pa.int64())], names=["term", "context", "n"])


def learn_lexicon(labelled: DataFrame, precision: float = 0.9, share: float = 0.02, least: int = 5, max_terms: int = 5000) -> tuple[dict, dict]:
    """Words and stems from (text, toxic), with their log-odds: in at least ``share`` of toxic documents, by contexts, and seldom elsewhere."""
    size = {r["toxic"]: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    n_toxic, n_clean = size.get(1, 0), size.get(0, 0)
    terms = labelled.mapInArrow(_terms, "term string, context string, n long").groupBy("term", "context").agg(F.sum("n").alias("n"))
    is_toxic = F.col("context").isNotNull()
    sums = terms.groupBy("term").agg(
        F.count("context").alias("contexts"), F.sum(F.when(is_toxic, F.col("n")).otherwise(0)).alias("toxic"), F.sum(F.when(is_toxic, 0).otherwise(F.col("n"))).alias("clean")
    )
    chosen = sums.where((F.col("contexts") >= max(least, share * n_toxic)) & (F.col("toxic") >= precision * (F.col("toxic") + F.col("clean"))))
    # a lexicon is of a bounded size: the best supported terms
    found = chosen.orderBy(F.desc("contexts"), "term").limit(max_terms).collect()
    words, stems = dict.fromkeys(INSULTS, 4.5), {}
    for r in sorted(found, key=lambda r: (len(r["term"]), r["term"])):
        odds = min(4.5, math.log((r["toxic"] + 0.5) / (n_toxic + 1)) - math.log((r["clean"] + 0.5) / (n_clean + 1)))  # a rare term is no stronger proof
        if r["term"].endswith("$"):
            words[r["term"][:-1]] = odds
        elif odds > max((stems.get(r["term"][:k], 0.0) for k in STEMS if k < len(r["term"])), default=0.0) + 0.5:
            stems[r["term"]] = odds  # a longer stem only where it says more
    return words, stems


def _scan(df: DataFrame, words: dict, stems: dict, finish, schema: str) -> DataFrame:
    """``finish(batch, features)`` for every batch; the first column of ``df`` is the text."""
    held = df.sparkSession.sparkContext.broadcast((words, stems))  # bounded by max_terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(*held.value)
        for batch in batches:
            x = np.array([lexicon.features(t) for t in batch.column(0).to_pylist()], float).reshape(-1, FEATURES)
            yield finish(batch, x)

    return df.mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", max_labelled: int = 20_000) -> Model:
    """Lexicon and regression from labelled documents outside the held-out third; at most about ``max_labelled`` of them."""
    labels = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(key)).groupBy(F.col(key).alias("_key")).agg(F.max(F.col(label).cast("int")).alias("toxic"))
    n = labels.count()
    if n > max_labelled:  # by hash: the same rows every time, from anywhere in the table
        labels = labels.where(F.pmod(F.xxhash64("_key", F.lit("sample")), F.lit(1 << 20)) < int((1 << 20) * max_labelled / n))
    sample = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("text")).join(F.broadcast(labels), "_key").select("text", "toxic")
    scratch = Scratch(docs.sparkSession, "toxicity")
    sample = scratch.save(sample.repartition(16), "sample")
    words, stems = learn_lexicon(sample)

    def features(batch: pa.RecordBatch, x: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(1), *(pa.array(x[:, i]) for i in range(FEATURES))], names=["toxic", *(f"x{i}" for i in range(FEATURES))])

    rows = _scan(sample, words, stems, features, "toxic int, " + ", ".join(f"x{i} double" for i in range(FEATURES))).toArrow()
    x = np.column_stack([rows.column(f"x{i}").to_numpy() for i in range(FEATURES)]).reshape(-1, FEATURES)
    y = rows.column("toxic").to_numpy().astype(float)
    scratch.drop("sample")
    return Model(words, stems, regress(x, y))


def regress(x: np.ndarray, y: np.ndarray, l2: float = 0.5, steps: int = 50) -> np.ndarray:
    """Logistic regression by Newton's method; the ridge keeps separable data finite. Without both labels: hits decide."""
    weights = np.zeros(x.shape[1] + 1)
    if len(y) == 0 or y.min() == y.max():
        weights[[0, -1]] = 1.5, -3.0
        return weights
    a = np.column_stack([x, np.ones(len(x))])
    ridge = np.full(a.shape[1], l2)
    ridge[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ weights, -30, 30)))
        g = a.T @ (y - p) - ridge * weights
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(ridge), g)
        weights = weights + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return weights


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, score and hits (terms found, exact or near) for every row."""
    source = docs.select(F.col(text).cast("string").alias("text"), F.col(key).alias("key"))
    kind = dict(source.dtypes)["key"]

    def finish(batch: pa.RecordBatch, x: np.ndarray) -> pa.RecordBatch:
        hits = np.rint(np.expm1(x[:, 1]) + np.expm1(x[:, 2])).astype(np.int64)  # from their logarithms
        return pa.RecordBatch.from_arrays([batch.column(1), pa.array(model.score(x)), pa.array(hits)], names=["key", "score", "hits"])

    return _scan(source, model.words, model.stems, finish, f"key {kind}, score double, hits long").withColumnRenamed("key", key)


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all their columns unchanged, whose score is below ``threshold``."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    source = docs.toDF(*names).select(F.col(names[docs.columns.index(text)]).cast("string").alias("_text"), *names)

    def finish(batch: pa.RecordBatch, x: np.ndarray) -> pa.RecordBatch:
        kept = pa.RecordBatch.from_arrays(batch.columns[1:], names=names)
        return kept.filter(pa.array(model.score(x) < threshold))

    schema = ", ".join(f"{n} {t}" for n, t in source.select(*names).dtypes)
    return _scan(source, model.words, model.stems, finish, schema).toDF(*docs.columns)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "hits")
