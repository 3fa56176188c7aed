"""Registered queries, all columns of their rows, against brute force on a small table of documents."""

import hashlib
import random
import struct
import zlib
from collections import Counter

import pytest

import __spark_entry__
from tests.llm.test_texts import VOCABULARY, brute_lines, corpus, frame, public_tokenizers

sha = lambda b: hashlib.sha256(b).hexdigest()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """(folder, {doc_id: text}): every document once, with an id."""
    folder = tmp_path_factory.mktemp("tables")
    rows = list({r[0]: r for r in corpus(11) if r[0] is not None}.values())
    frame(spark, rows).write.parquet(f"{folder}/documents.parquet")
    return str(folder), {r[0]: r[1] or "" for r in rows}


def rows_of(spark, name, folder, *columns):
    got = __spark_entry__.queries()[name](spark, folder).select(*columns).collect()
    return sorted(map(tuple, got))


def test_op3(spark, tables):
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    folder, texts = tables
    reference = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(str(VOCABULARY)), special_tokens={})
    want = []
    for i, t in texts.items():
        ids = reference.encode_ordinary(t)
        want.append((i, len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(t.encode())))
    assert rows_of(spark, "op3_bpe", folder, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want)


def test_op4(spark, tables):
    folder, texts = tables
    bodies = {i: t.encode() for i, t in texts.items()}
    count = Counter(b[j : j + 400] for b in bodies.values() for j in range(len(b) - 399))
    want = []
    for i, b in bodies.items():
        gone = bytearray(len(b))
        for j in range(len(b) - 399):
            if count[b[j : j + 400]] > 1:
                gone[j : j + 400] = b"\1" * 400
        spans = sum(1 for j, g in enumerate(gone) if g and not (j and gone[j - 1]))
        want.append((i, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g))))
    assert any(w[3] for w in want)
    assert rows_of(spark, "op4_suffix_dedup", folder, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(want)


def test_op8(spark, tables):
    folder, texts = tables
    seen, want = set(), []
    for i, t in sorted(texts.items()):
        words = t.encode().split()
        gone = [False] * len(words)
        for j in range(len(words) - 19):
            window = tuple(words[j : j + 20])
            if window in seen:
                gone[j : j + 20] = [True] * 20
            seen.add(window)
        want.append((i, len(words), sum(gone), sha(b" ".join(w for w, g in zip(words, gone, strict=True) if not g))))
    assert any(w[2] for w in want)
    assert rows_of(spark, "op8_substring_dedup", folder, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(want)


def words_of(text):
    return [x.decode() for x in (text or "").encode().split()]


def test_op5(spark, tmp_path):
    """Sizes, targets and bounds; a source of empty texts and an empty table."""
    rows = [(i, t, None, "void" if i == 63 else s, 0, "k", "o", "t") for i, t, _, s, *_ in {r[0]: r for r in corpus(12, 150) if r[0] is not None}.values()]
    rows += [(1000 + i, None if i else "  ", None, "z", 0, "k", "o", "t") for i in range(2)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    size = {r[0]: len(words_of(r[1])) for r in rows}
    total = Counter()
    for r in rows:
        total[r[3]] += size[r[0]]
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight, target, pool = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, {}, 1.5 * sum(total.values())
    while True:
        free = [s for s in order if s not in target]
        part = {s: (pool - sum(target.values())) * weight[s] / sum(weight[x] for x in free) for s in free}
        full = [s for s in free if part[s] > 2 * total[s]]
        if not full:
            break
        target |= {s: 2.0 * total[s] for s in full}
    target |= part
    columns = ("doc_id", "size", "source_size", "target", "taken")
    got = rows_of(spark, "op5_mixing", str(tmp_path), *columns)
    assert [x[:3] for x in got] == sorted((r[0], size[r[0]], total[r[3]]) for r in rows)
    source = {r[0]: r[3] for r in rows}
    taken = Counter()
    for i, n, _, wanted, mine in got:
        assert wanted == pytest.approx(target[source[i]]) and 0 <= mine <= 2 * n
        taken[source[i]] += mine
    for s in order:
        assert abs(taken[s] - target[s]) <= max(256, 0.02 * target[s]), s
    assert rows_of(spark, "op5_mixing", str(tmp_path), *columns) == got
    frame(spark, []).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert rows_of(spark, "op5_mixing", f"{tmp_path}/none", *columns) == []


def test_op7(spark, tables):
    folder, texts = tables
    want = []
    for i, t in texts.items():
        w = words_of(t)
        seen = Counter(zip(w, w[1:], w[2:], strict=False))
        again = len({k for j in range(len(w) - 2) if seen[tuple(w[j : j + 3])] > 1 for k in (j, j + 1, j + 2)})
        lines = [x for x in t.split("\n") if words_of(x)]
        want.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), again, len(w) < 50 or 100 * again > 50 * len(w)))
    got = rows_of(spark, "op7_quality", folder, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert [x[:-1] for x in got] == sorted(want)
    assert all(x[-1] is not None and not (x[-2] and x[-1]) for x in got)


def test_op9_of_few(spark, tmp_path):
    """With fewer than 20 candidates all come, nearest first, ties to the smaller id; broken vectors take no part."""
    x = [[float((i * 7) % 5), 1.0, float(i % 3) - 1] for i in range(15)]
    rows = [(i * 10, v) for i, v in enumerate(x)] + [(200, None), (220, [0.0] * 3), (240, [float("inf"), 0.0, 1.0]), (260, [None, 1.0, 1.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = []
    for q in range(0, 15, 2):
        scores = sorted((-sum(a * b for a, b in zip(x[q], x[i], strict=True)), i * 10) for i in range(15) if i != q)
        want += [(q * 10, rank, i, -s) for rank, (s, i) in enumerate(scores, 1)]
    assert rows_of(spark, "op9_nearest", str(tmp_path), "query_id", "rank", "vec_id", "score") == sorted(want)


def test_op6(spark, tables):
    folder, texts = tables
    rows = [r for r in {r[0]: r for r in corpus(11) if r[0] is not None}.values()]
    gone = {}
    for i, _, j in brute_lines(rows):
        gone.setdefault(i, []).append(j)
    got = rows_of(spark, "op6_line_dedup", folder, "doc_id", "n_lines", "n_removed", "removed")
    want = [(r[0], 0 if r[1] is None else r[1].count("\n") + 1, len(gone.get(r[0], [])), sorted(gone.get(r[0], []))) for r in rows]
    assert [(*x[:3], sorted(x[3])) for x in got] == sorted(want) and any(w[2] for w in want)


def test_op10(spark, tmp_path):
    """Held-out labels have no part in the scores; every document has one."""
    rng = random.Random(8)
    words = [f"{a}{b}um" for a in "bdfgk" for b in "aeiou"]
    rows = [(i, " ".join(rng.choices(words, k=40) + (["zorgling"] if i % 4 == 0 else [])), None, "s", 0, "k", "o", "t") for i in range(160)]
    rows += [(900, None, *rows[0][2:]), (901, "", *rows[0][2:])]
    held = {r[0]: zlib.crc32(str(r[0]).encode()) % 3 == 1 for r in rows}
    found = []
    for name, turned in (("a", False), ("b", True)):
        folder = f"{tmp_path}/{name}"
        frame(spark, rows).write.parquet(f"{folder}/documents.parquet")
        labels = [(r[0], int((r[0] % 4 == 0) != (turned and held[r[0]]))) for r in rows[:160]]
        spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
        found.append(rows_of(spark, "op10_toxicity", folder, "doc_id", "held_out", "score", "predicted"))
    assert [x[:2] for x in found[0]] == sorted(held.items())
    assert all(0 <= s <= 1 and p == (s >= 0.7) for _, _, s, p in found[0])
    assert [x[2] for x in found[1]] == pytest.approx([x[2] for x in found[0]], abs=1e-9)
    assert all(p == (i % 4 == 0) for i, h, _, p in found[0] if h and i < 160)
