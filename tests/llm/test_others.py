"""URL rules, mixing, nearest neighbours, components and the pipeline."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.llm import ann, mixing, url_filter
from riskweave.llm.common import Scratch
from riskweave.llm.components import components


def test_url_rules(spark):
    rng = random.Random(1)
    urls = [None, "", "no scheme", "http://", "HTTP://COM/en/", "x://a.b.org/es/#f", "http://org/es/?q", "http://notcom/en/1", "http://example.com/en/7", "http://Example.NET/de/81?x#y", "http://com:80/en/", "http://..com/en/"]
    urls += [f"http://{rng.choice(['', 'a.', 'm.b.'])}{rng.choice(['com', 'example.com', 'net', 'example.net', 'org', 'borg'])}/{rng.choice(['en', 'de', 'es'])}/{rng.randint(1, 99)}" for _ in range(300)]
    rows = [(i if i % 50 else None, u, "x", "y") for i, u in enumerate(urls)]
    pages = spark.createDataFrame(rows + rows[:5], "page_id long, url string, host string, rule string")

    def judge(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = rest[:cut].translate({c: c + 32 for c in range(65, 91)}), rest[cut:]
        path = tail[: min([tail.index(c) for c in "?#" if c in tail], default=len(tail))]
        fits = [(len(r), r, v) for v, r in url_filter.RULES for rh, rp in [(r.partition("/")[0], "/" + r.partition("/")[2])] if (host == rh or host.endswith("." + rh)) and path.startswith(rp)]
        return (host, path, *max(fits)[1:]) if fits else (host, path, None, "allow")

    got = url_filter.judge(pages, url_filter.list_table(spark, url_filter.RULES)).collect()
    assert Counter(tuple(r) for r in got) == Counter((i, *judge(u)) for i, u, *_ in rows + rows[:5])
    assert url_filter.judge(pages.where("false"), url_filter.list_table(spark, url_filter.RULES)).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, url_filter.list_table(spark, [])).collect()} == {"allow"}


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("h"))
    bloom = url_filter.BlockedBloom.build(keys, 5000, 1 << 20)
    h = np.array([r.h for r in keys.collect()], np.int64)
    assert bloom.may_have(h).all()
    assert bloom.may_have(np.random.default_rng(0).integers(-(2**62), 2**62, 20_000)).mean() < 0.02


def test_targets():
    assert mixing.targets([("a", 100), ("b", 100), (None, 100)]) == pytest.approx({"a": 200.0, "b": 83.333333, None: 166.666667})
    assert mixing.targets([]) == {}


def test_permutation():
    for n in (1, 2, 3, 100, 257):
        got = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 9, np.uint64))
        assert sorted(got.tolist()) == list(range(n))


def documents(spark, n=400, seed=2):
    rng = random.Random(seed)
    rows = [(i, " ".join(f"w{rng.randint(0, 999)}" for _ in range(rng.randint(0, 400))), rng.choice(["a", "b", "c", None, "a", "a"]), "x") for i in range(n)]
    rows += [(n, None, "a", "x"), (n + 1, "", None, "x"), (None, "q r s", "b", "x"), rows[0], rows[0]]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, block string"), rows


def test_mix(spark):
    docs, rows = documents(spark)
    plan = mixing.mix(docs, Scratch(spark, "t"), [F.col("doc_id")])
    words = {s: sum(len((t or "").split()) for _, t, x, _ in rows if x == s) for s in ("a", "b", "c", None)}
    target = mixing.targets(list(words.items()))
    taken = {r.source: r.n for r in plan.rows().join(plan.documents.select("src", "source").distinct(), "src").groupBy("source").agg(F.sum("words").alias("n")).collect()}
    for s, n in words.items():
        assert plan.sources[s][1:] == (n, target[s]) and taken[s] == pytest.approx(target[s], rel=0.02)
    each = plan.rows().groupBy("src", "offset").agg(F.sum("words").alias("n"), F.first("size").alias("size")).collect()
    assert all(r.n <= 2 * r["size"] for r in each)
    again = mixing.mix(docs, Scratch(spark, "t"), [F.col("doc_id")])
    assert Counter(map(tuple, again.rows().collect())) == Counter(map(tuple, plan.rows().collect()))
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert sum(len(r.text.split()) for r in out.collect()) == sum(taken.values())
    assert mixing.mixed_documents(docs.where("false")).count() == 0


@pytest.mark.parametrize("n", [300, 3000])
def test_nearest(spark, n):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(n, 16)) * rng.uniform(0.5, 2, size=(n, 1))
    x[50:90] = x[49]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(n, None, 0), (n + 1, [], 0), (n + 2, [0.0] * 16, 0), (n + 3, [float("nan")] * 16, 0), (n + 4, [1.0] * 3, 0), (None, [1.0] * 16, 0)]
    valid = ann.valid(spark.createDataFrame(rows, "vec_id long, embedding array<double>, list int"), "vec_id", "embedding")
    index = ann.build(valid, Scratch(spark, "t"))
    got = {}
    for r in ann.search(index, valid.where(F.col("id") % 20 == 0)).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    right = total = 0
    for q in range(0, n, 20):
        score = np.zeros(n)
        for d in range(16):
            score += x[q, d] * x[:, d]
        want = [i for i in np.lexsort((np.arange(n), -score)) if i != q][:20]
        assert sorted(got[q]) == list(range(1, 21))
        assert all(score[i] == s for i, s in got[q].values())
        right += len(set(want) & {i for i, _ in got[q].values()})
        total += 20
    assert right / total >= 0.9
    empty = valid.where("false")
    assert ann.search(ann.build(empty, Scratch(spark, "t")), empty).count() == 0


def test_nearest_visits_all_lists_in_the_ratio():
    """Centroids without structure, many more within the ratio than the beam holds."""
    s, rng, sizes = ann.Settings(), np.random.default_rng(4), []
    c = rng.normal(size=(2000, 64))
    graph = ann.CentroidGraph(c, s.degree, s.beam)
    for x in rng.normal(size=(20, 64)):
        d = np.sqrt(((c - x) ** 2).sum(1))
        want = set(np.flatnonzero(d <= s.ratio * d.min()).tolist())
        found, far = graph.search(x, s.ratio)
        got = set(found[np.sqrt(far) <= s.ratio * np.sqrt(far[0])].tolist())
        sizes.append(len(want))
        assert len(got & want) >= 0.99 * len(want)
    assert np.median(sizes) > s.beam


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(400 + i, 401 + i) for i in range(40)]
    root = list(range(500))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "t"), "c").collect()}
    assert got == {i: find(i) for pair in links if pair[0] != pair[1] for i in pair}


def test_pipeline(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    pytest.importorskip("public_tokenizers")
    rng = random.Random(3)
    prose = lambda k: " ".join(f"w{rng.randint(0, 3000)}" for _ in range(k)) + "\n"
    texts = ["".join(prose(12) for _ in range(6)) for _ in range(60)]
    texts += [texts[0], texts[1].replace("w1", "w2", 1), None, "", "you idiot moron you stupid worthless scum"]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)] + [(None, texts[5], None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0) for i in range(60)] + [(64, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, stages, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), corpus_pipeline.STAGES, {}
    assert [n for n, _ in stages] == ["toxicity", "line_dedup", "near_dedup", "mixing", "bpe"]
    for name, stage in stages:
        out = stage(spark, docs, str(tmp_path))
        if name != "bpe":
            assert out.columns == schema.replace(" long", "").replace(" string", "").split(", ")
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r.doc_id for r in docs.collect()}
    assert 64 not in kept["toxicity"] and kept["toxicity"] >= set(range(60))
    assert 60 not in kept["line_dedup"] and kept["near_dedup"] >= set(range(60))
    assert docs.where(F.col("text").isNull()).count() == 0 and docs.count() > 0
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter(map(tuple, whole.select("doc_id", "n_tokens").collect())) == Counter(map(tuple, docs.select("doc_id", "n_tokens").collect()))
