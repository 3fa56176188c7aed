"""Nearest neighbours on uneven data: full numbers of rows, recall, huge components, repeated rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.llm import ann
from riskweave.llm.common import Scratch

SCHEMA = "vec_id long, embedding array<double>, list int, shard int, slice int"


def uneven(n=4000, dims=16):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(n, dims))
    return x / np.linalg.norm(x, axis=1, keepdims=True) * np.exp(rng.normal(size=(n, 1)))


def tight_groups():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(6000, 16))
    groups = np.repeat(rng.normal(size=(6, 16)), 5, axis=0) + 1e-4 * rng.normal(size=(30, 16))
    x = np.concatenate((x, groups))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def found(spark, x, settings=ann.Settings(), ids=None, every=20):
    ids = range(len(x)) if ids is None else ids
    df = spark.createDataFrame([(int(i), [float(c) for c in v], 1, 2, 3) for i, v in zip(ids, x)], SCHEMA)
    rows = ann.valid(df, "vec_id", "embedding")
    out = {}
    for r in ann.search(ann.build(rows, Scratch(spark, "t"), settings), rows.where(F.col("id") % every == 0)).collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: sorted(v) for q, v in out.items()}


@pytest.mark.parametrize("make, few", [(uneven, False), (tight_groups, False), (uneven, True)])
def test_all_rows_and_recall(spark, make, few):
    x = make()
    # few: only the nearest list is visited, and lists are small: most queries have to be completed
    settings = ann.Settings(least=1, ratio=1.0, list_size=12, replicas=1, queries=50) if few else ann.Settings()
    got = found(spark, x, settings)
    assert set(got) == set(range(0, len(x), 20)) and all([r for r, _, _ in v] == list(range(1, 21)) for v in got.values())
    hits = 0
    for q, rows in got.items():
        score = x @ x[q]
        score[q] = -np.inf
        hits += len(set(np.argsort(-score, kind="stable")[:20].tolist()) & {i for _, i, _ in rows})
        assert [s for _, _, s in rows] == pytest.approx([x[q] @ x[i] for _, i, _ in rows])
    assert few or hits >= 0.9 * 20 * len(got)


def test_huge_components(spark):
    x = uneven(300, 4)
    x[7], x[20], x[33] = [1e200, -1e200, 0, 0], [1e200, 1e200, 0, 0], [1e308] * 4
    got = found(spark, x)
    assert set(got) == set(range(0, 300, 20)) and all(len(v) == 20 for v in got.values())
    assert not any(np.isnan(s) for v in got.values() for _, _, s in v)
    for q in (0, 40):
        with np.errstate(over="ignore"):
            want = sorted((-(sum(a * b for a, b in zip(x[q], v))), i) for i, v in enumerate(x) if i != q)[:20]
        assert [i for _, i, _ in got[q]] == [i for _, i in want]
    # 1e200 * 1e200 - 1e200 * 1e200 has no sign in double precision; the exact product is 0
    assert got[20][0][1:] == (33, np.inf)


def test_repeated_rows(spark):
    x = uneven(200, 4)
    ids = list(range(200)) + [5] * 150
    x = np.concatenate((x, np.repeat(x[5:6], 150, axis=0)))
    got = found(spark, x, ids=ids)
    for q, rows in got.items():
        want = sorted({(-(x[q] @ x[i]), i) for i in range(200) if i != q})[:20]
        assert [i for _, i, _ in rows] == [i for _, i in want]
    few = found(spark, x[:3], ids=[0, 20, 21])
    assert {q: len(v) for q, v in few.items()} == {0: 2, 20: 2}


def test_recall_holds_whatever_the_lists(spark):
    """Short lists, few visits, no replicas: the probes have to raise the number of visits."""
    x = tight_groups()
    got = found(spark, x, ann.Settings(least=1, ratio=1.0, list_size=60, replicas=1))
    hits = 0
    for q, rows in got.items():
        score = x @ x[q]
        score[q] = -np.inf
        hits += len(set(np.argsort(-score, kind="stable")[:20].tolist()) & {i for _, i, _ in rows})
    assert hits >= 0.95 * 20 * len(got)


def test_blocks_score_only_what_can_be_among_the_best(monkeypatch):
    """Replicas are met once, and rows below a query's best so far are not scored: in vectors without structure, where all lists are visited."""
    rng = np.random.default_rng(7)
    x = np.repeat(rng.normal(size=(8000, 16)), 4, axis=0)
    ids = np.repeat(np.arange(8000), 4)
    once = ann.distinct_rows(ids, x)
    assert len(once) == 8000
    q, qids, scored, scores = x[::400], ids[::400], [], ann.scores
    monkeypatch.setattr(ann, "scores", lambda a, b: scored.append(len(a)) or scores(a, b))
    got = ann.best_in_blocks(q, qids, x[once], ids[once], 20, block=1000)
    assert sum(scored) < 0.05 * len(q) * len(once)
    monkeypatch.undo()
    whole = ann.best_rows([ann.best_of(q, qids, x[once], ids[once], 20)], 20)
    assert all(np.array_equal(a, b) for a, b in zip(got, whole, strict=True))
