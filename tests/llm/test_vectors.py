"""Top-k search, hard negatives and the divergence audit against brute force, with ties, repeated rows and odd values."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.llm import blocks, divergence, hard_negatives, topk
from riskweave.llm.common import Scratch

SCHEMA = "vec_id long, embedding array<double>, label int, row string, part int"


def vectors(n, dims, seed, spread=1.0):
    """Random vectors with copies, ties, zero vectors, other lengths, nulls and non-finite components."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims)) / np.sqrt(dims) * np.exp(rng.normal(size=(n, 1)) * spread)
    x[n // 2 : n // 2 + n // 8] = x[0]  # many copies of one vector: ties at every rank
    rows = [(i, [float(v) for v in x[i]], int(rng.integers(3)), "r", 1) for i in range(n)]
    odd = [
        (None, rows[1][1], 1, "r", 1), (n + 1, None, 1, "r", 1), (n + 2, [float("nan")] + rows[1][1][1:], 1, "r", 1), (n + 3, [None] + rows[1][1][1:], 1, "r", 1), (n + 4, [float("inf")] * dims, 1, "r", 1),
        (n + 5, [0.0] * dims, 1, "r", 1), (n + 6, [], 2, "r", 1), (n + 7, rows[2][1][:3], 0, "r", 1), (n + 8, rows[2][1], None, "r", 1), (n + 9, [1.0] * (dims + 2), 1, "r", 1), rows[5],
    ]
    return rows + odd


def taken(rows, scale, labels):
    good = [(i, [int(np.floor(scale * v)) for v in x], y) for i, x, y, *_ in rows if i is not None and x is not None and (y is not None or not labels) and all(v is not None and np.isfinite(v) for v in x)]
    return [(i, x, y, k) for k, (i, x, y) in enumerate(good)]


def inner(a, b):
    return sum(x * y for x, y in zip(a, b))


def best_others(rows, k, every):
    out = []
    for i, x, _, me in rows:
        if i % every == 0:
            found = sorted((-inner(x, z), j) for j, z, _, other in rows if other != me)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found)]
    return Counter(out)


@pytest.mark.parametrize("block, spread", [(1 << 20, 0.3), (2000, 1.0)])
def test_topk(spark, monkeypatch, block, spread):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", block)
    monkeypatch.setattr(blocks, "SLICE_BYTES", 1000)
    rows = vectors(500, 12, 1, spread)
    df = spark.createDataFrame(rows, SCHEMA)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = topk.search(blocks.usable(df, "vec_id", "embedding"), F.col("id") % 20 == 0, 10, 1024, Scratch(spark, "t")).collect()
    assert Counter(tuple(r) for r in got) == best_others(taken(rows, 1024, False), 10, 20)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= int(before)
    few = df.where("vec_id IN (0, 20, 40)")
    got = topk.search(blocks.usable(few, "vec_id", "embedding"), F.col("id") % 20 == 0, 10, 1024, Scratch(spark, "t")).collect()
    assert len(got) == 6 and topk.search(blocks.usable(df.where("false"), "vec_id", "embedding"), F.col("id") % 20 == 0, 10, 1024, Scratch(spark, "t")).count() == 0


def test_topk_of_huge_components(spark):
    rows = [(i, [float(i) * 10.0 ** (12 * (i % 4)), -3.0], 0, "r", 1) for i in range(40)] + [(100, [1e200, 1e308], 0, "r", 1)]
    got = topk.search(blocks.usable(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding"), F.col("id") % 10 == 0, 5, 1024, Scratch(spark, "t")).collect()
    whole = [(i, [int(v) * 1024 for v in x], y, k) for k, (i, x, y, *_) in enumerate(rows)]
    clip = lambda v: max(-blocks.LIMIT, min(blocks.LIMIT, v))
    for i, x, _, me in whole:
        if i % 10 == 0:
            found = sorted((-clip(inner(x, z)), j) for j, z, _, other in whole if other != me)[:5]
            assert [(r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == i), key=lambda r: r["rank"])] == [(j, -s) for s, j in found]


def negatives(rows, every, least, most, positives=5, k=10):
    out = []
    for i, x, y, me in rows:
        if i % every:
            continue
        score = [(-inner(x, z), j, label) for j, z, label, other in rows if other != me]
        for s, j in sorted((s, j) for s, j, label in score if label == y)[:positives]:
            fit = sorted((t, h) for t, h, label in score if label != y and least * -s <= 100 * -t <= most * -s)[:k]
            out += [(i, j, r + 1, h, -s, -t) for r, (t, h) in enumerate(fit)]
    return Counter(out)


@pytest.mark.parametrize("block, bits", [(1 << 20, 10), (3000, 3)])
def test_hard_negatives(spark, monkeypatch, block, bits):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", block)
    monkeypatch.setattr(blocks, "SLICE_BYTES", 1000)
    monkeypatch.setattr(hard_negatives, "BITS", bits)
    rows = vectors(400, 8, 2, 0.4)
    df = spark.createDataFrame(rows, SCHEMA)
    got = hard_negatives.mine(blocks.usable(df, "vec_id", "embedding", "label"), F.col("id") % 20 == 0, 256, 5, 10, 30, 90, Scratch(spark, "t")).collect()
    assert Counter(tuple(r) for r in got) == negatives(taken(rows, 256, True), 20, 30, 90)
    assert hard_negatives.mine(blocks.usable(df.where("false"), "vec_id", "embedding", "label"), F.col("id") % 20 == 0, 256, 5, 10, 30, 90, Scratch(spark, "t")).count() == 0


def audited(docs, least, top):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, found = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in docs:
        terms = term.findall((text or "").translate(lower))
        counts[lang or "", source or ""].update(terms)
        found[lang or ""].update(set(terms))
    out = []
    for lang in found:
        kept = [t for t, n in found[lang].items() if n >= least]
        sources = [s for g, s in counts if g == lang]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[t] for t in kept) + 5 * len(kept)) for t in kept}  # noqa: B023, E731
        whole = share(sum((counts[lang, s] for s in sources), Counter()))
        of = {s: share(counts[lang, s]) for s in sources}
        for s in sources:
            pairs = [(-sum(abs(of[s][t] - of[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            terms = [(whole[t] - of[s][t], t.encode()) for t in kept if counts[lang, s][t] and of[s][t] > whole[t]]
            for part, rows, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                out += [(lang, s, part, item.decode(), -v, r + 1) for r, (v, item) in enumerate(sorted(rows)[:most])]
    return Counter(out)


def test_divergence(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 50)
    monkeypatch.setattr(divergence, "PIECE", 40)
    rng = random.Random(5)
    words = [f"w{chr(97 + i)}" for i in range(20)] + ["Über", "ÜBER", "naïve", "日本", "A", "a", "don't", "x1y"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 30))) + rng.choice(["", "\n", "!", " 12 "]), rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "S2", "é", None])) for i in range(300)]
    docs += [(1000, None, "en", "none"), (1001, "zz " * 5000, "en", "long"), (1002, "1 2 3", "xx", "a"), (1003, "", "xx", "b"), (1004, "", "yy", "only"), docs[0], docs[0]]
    df = spark.createDataFrame([(*d, 1, "c") for d in docs], "doc_id long, text string, lang string, source string, term int, item string")
    got = divergence.audit(df, Scratch(spark, "t"), 8, 6).collect()
    assert Counter(tuple(r) for r in got) == audited(docs, 8, 6)
    assert divergence.audit(df.where("false"), Scratch(spark, "t")).count() == 0


def test_term_pieces():
    text = ("Abé-c" * 7 + " " + "üX" * 60).encode()
    monkey = divergence.PIECE
    try:
        divergence.PIECE = 10
        assert [t for p in divergence.term_pieces(text) for t in p] == ["abé".encode(), *[b"cab\xc3\xa9"] * 6, b"c", ("üx" * 60).encode()]
    finally:
        divergence.PIECE = monkey
