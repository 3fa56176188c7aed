"""Corpus operators on texts against brute force: repeats, lines, near copies, tokens, quality, toxicity."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.llm import bpe, line_dedup, near_dedup, quality, substring_dedup, suffix_dedup, toxicity
from riskweave.llm.common import Scratch, ByteHasher

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k1 string, ord string, text_2 string"


def corpus(seed=1, n=60):
    """Random texts with copies, near copies, shared passages, repeated lines and the odd cases."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeé日", k=rng.randint(2, 7))) for _ in range(400)]
    prose = lambda k: "".join(w + ("\n" if rng.random() < 0.08 else " ") for w in rng.choices(words, k=k))
    passage, texts = prose(90), []
    for i in range(n):
        t = prose(rng.randint(5, 200))
        if i % 6 == 0:
            t = prose(20) + passage + t
        if i % 9 == 1:
            t = texts[-1]
        if i % 9 == 2:
            w = texts[-1].split(" ")
            w[len(w) // 2] = "changed"
            t = " ".join(w)
        texts.append(t)
    texts += [None, "", "   \n ", "x", "same " * 300, "ab\n" * 200, prose(6000)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, texts[4]), (None, None)]
    return [(i, t, None, f"s{(i or 0) % 3}" if i else None, len(t or ""), "k", "o", "t") for i, t in rows]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_empty_tables(spark):
    empty = frame(spark, [])
    assert bpe.transcode(empty, VOCABULARY, public_tokenizers.PATTERN).count() == 0
    assert quality.judge(empty).count() == 0
    assert line_dedup.without_lines(empty).count() == 0
    assert near_dedup.one_of_each(empty).count() == 0
    places, changed = substring_dedup.repeated_spans(empty, Scratch(spark, "t"))
    assert places.rows.count() == 0 and changed.count() == 0
    places, changed = suffix_dedup.repeated_bytes(empty, Scratch(spark, "t"))
    assert places.rows.count() == 0 and changed.count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.keep_clean(empty, toxicity.fit(empty, labels)).count() == 0


def test_bpe_is_tiktoken(spark):
    import tiktoken

    ranks = {t: i for i, t in enumerate(bpe.read_ranks(VOCABULARY))}
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = corpus() + [(1000 + i, t, *([None] * 6)) for i, t in enumerate(["<|endoftext|> <unk> ▁", "\u00a0 \x85a\r\n\t", "It's  9½ 🎉👩‍👩‍👧", "é" * 999])]
    got = bpe.transcode(frame(spark, rows), VOCABULARY, public_tokenizers.PATTERN).collect()
    want = Counter((r[0], np.array(theirs.encode_ordinary(r[1] or ""), "<u4").tobytes(), (r[1] or "").encode()) for r in rows)
    assert Counter((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in got) == want


def test_quality_measures(spark):
    rows = corpus(2) + [(900, "### $$$ " * 80, *([None] * 6)), (901, "\n".join(["one two three four"] * 30), *([None] * 6))]
    got = {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.judge(frame(spark, rows)).collect()}
    want = set()
    for r in rows:
        text = r[1] or ""
        w = [x.decode() for x in text.encode().split()]
        seen = Counter(zip(w, w[1:], w[2:], strict=False))
        in_window = {k for j in range(len(w) - 2) if seen[tuple(w[j : j + 3])] > 1 for k in (j, j + 1, j + 2)}
        lines = [x for x in text.split("\n") if x.encode().split()]
        want.add((r[0], len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(in_window), len(w) < 50 or 100 * len(in_window) > 50 * len(w)))
    assert got == want


def test_quality_verdict(spark):
    rng = random.Random(4)
    good = [(i, " ".join(rng.choices(["alpha", "betas", "gamma", "delta"] + [f"w{k}ord" for k in range(300)], k=120)), *([None] * 6)) for i in range(60)]
    junk = [(100 + i, " ".join(f"w{rng.randint(0, 500)}###" for _ in range(120)), *([None] * 6)) for i in range(12)]
    kept = {r.doc_id: r.kept for r in quality.judge(frame(spark, good + junk)).collect()}
    assert all(kept[i] for i in range(60)) and not any(kept[100 + i] for i in range(12))


def brute_lines(rows):
    """Removed (doc_id, text, line) by comparing every line with every earlier one."""
    order = sorted({(r[0] is None, r[0] or 0, r[1] or "") for r in rows})
    earlier, gone = [], set()
    for last, i, text in order:
        for j, line in enumerate(text.split("\n")):
            w = line.encode().split()
            if w:
                if any(w == x or (min(len(w), len(x)) >= line_dedup.WORDS_AN_EDIT and line_dedup.within_one(w, x)) for x in earlier):
                    gone.add((None if last else i, text, j))
                earlier.append(w)
    return gone


def test_lines(spark):
    rng = random.Random(3)
    base = [[rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(3, 14))] for _ in range(40)]
    texts = []
    for _ in range(40):
        lines = []
        for _ in range(5):
            w = list(rng.choice(base))
            edit = rng.random()
            if edit < 0.3:
                w[rng.randrange(len(w))] = "zz"
            elif edit < 0.5:
                del w[rng.randrange(len(w))]
            elif edit < 0.6:
                w.insert(rng.randrange(len(w)), w[0])
            lines.append(" ".join(w))
        texts.append("\n".join(lines))
    rows = [(i, t, *([None] * 6)) for i, t in enumerate(texts)] + [(i + 100, *r[1:]) if r[0] is not None else r for i, r in enumerate(corpus(5, 20))]
    want = brute_lines(rows)
    docs = frame(spark, rows)
    found = docs.select(*line_dedup.row_keys(F.col("doc_id"), F.col("text")), "doc_id", "text").distinct().join(line_dedup.find(docs, Scratch(spark, "t")), ["k1", "k2"]).collect()
    assert {(r.doc_id, r.text, j) for r in found for j in r.removed} == want
    kept = line_dedup.without_lines(docs)
    assert kept.columns == docs.columns
    assert sum((r.text or "").count("\n") for r in kept.collect()) < sum((r[1] or "").count("\n") for r in rows)


def test_short_lines(spark):
    """Exact copies of lines of any length go; near copies from four words on, also of a shorter earlier line."""
    texts = ["日本語\none two\na b c d e\na b c d e f g", "日本語\none two\n \na b x d e\na b c d e f g h\none three"]
    docs = frame(spark, [(i, t, *([None] * 6)) for i, t in enumerate(texts)])
    assert {r.doc_id: r.text for r in line_dedup.without_lines(docs).collect()} == {0: texts[0], 1: " \none three"}


def test_substrings(spark):
    rows = [r for r in corpus(6) if r[0] is not None]
    places, changed = substring_dedup.repeated_spans(frame(spark, rows), Scratch(spark, "t"))
    got = {}
    for r in places.rows.join(changed, "ord", "left").collect():
        copy = not r.first and r.n_words >= substring_dedup.K
        whole = b" ".join((dict((x[0], x[1]) for x in rows)[r.id] or "").encode().split()).decode()
        got[r.id] = (r.n_words, r.n_words if copy else r.n_removed or 0, "" if copy else r.kept if r.kept is not None else whole)
    seen, want = {}, {}
    for i, text in sorted({(r[0], r[1] or "") for r in rows}):
        w = text.encode().split()
        gone = [False] * len(w)
        for j in range(len(w) - 19):
            if (at := seen.setdefault(tuple(w[j : j + 20]), (i, j))) != (i, j):
                assert at < (i, j)
                gone[j : j + 20] = [True] * 20
        want[i] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode())
    assert got == want


def test_substring_paths(spark):
    """Spans run along their source, on paths that go on across documents; a collision of all hashes removes nothing wrong."""
    words = [f"w{i}" for i in range(90)]
    texts = [" ".join(words[:40]), " ".join(words[21:]), " ".join(words), "other " * 30, " ".join(words) + " end"]
    docs = frame(spark, [(i, t, *([None] * 6)) for i, t in enumerate(texts)] + [(None, texts[0] + " x", *([None] * 6))])
    _, changed = substring_dedup.repeated_spans(docs, Scratch(spark, "t"))
    got = {r.kept: (r.n_removed, r.spans) for r in changed.collect()}
    assert {k: v[0] for k, v in got.items()} == {"": 90, "other": 29, "end": 90, "x": 40}
    spans = got["end"][1]
    assert len({s.path for s in spans}) == 1 and [s.path_start for s in spans] == [s.start for s in spans] and len({s.source for s in spans}) == 2
    places, changed = substring_dedup.repeated_spans(docs, Scratch(spark, "t"), bits=0)
    true = {0: 0, 1: 0, 2: 90, 3: 29, 4: 90, None: 40}
    for r in places.rows.join(changed, "ord").collect():
        assert r.n_removed <= true[r.id]


@pytest.mark.parametrize("bucket", [500, 1])
def test_suffixes(spark, monkeypatch, bucket):
    monkeypatch.setattr(suffix_dedup, "BUCKET", bucket)
    rows = corpus(7)
    places, changed = suffix_dedup.repeated_bytes(frame(spark, rows), Scratch(spark, "t"))
    bodies = [(r[0], (r[1] or "").encode()) for r in rows]
    count = Counter(b[j : j + 400] for _, b in bodies for j in range(len(b) - 399))
    want = Counter()
    for i, b in bodies:
        gone = np.zeros(len(b) + 1, int)
        for j in range(len(b) - 399):
            if count[b[j : j + 400]] > 1:
                gone[j] += 1
                gone[j + 400] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        want[(i, len(b), int(gone.sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())] += 1
    got = Counter()
    for r in places.rows.join(changed, "ord", "left").collect():
        copy = r.copies > 1 and r.n_bytes >= 400
        removed = r.n_bytes if copy else sum(s.stop - s.start for s in r.spans or [])
        digest = hashlib.sha256(b"").hexdigest() if copy else hashlib.sha256(bytes(r.kept)).hexdigest() if r.kept is not None else r.whole
        got[(r.id, r.n_bytes, removed, digest)] += 1
    assert got == want


def test_suffix_array():
    rng = np.random.default_rng(0)
    for n in [*range(12), 50, 301, 302, 303]:
        for letters in (1, 2, 5, 250):
            t = rng.integers(0, letters, n)
            assert suffix_dedup.suffix_array(t).tolist() == sorted(range(n), key=lambda i: t[i:].tolist())


def test_near_copies(spark):
    rows = corpus(8)
    s = near_dedup.Settings()
    hasher = ByteHasher()
    texts = sorted({r[1] or "" for r in rows})
    bags = {t: near_dedup.shingles(hasher, t, 5) for t in texts}
    counts = np.zeros(s.buckets, np.int64)
    for r in rows:
        np.add.at(counts, (bags[r[1] or ""][0] & np.uint64(s.buckets - 1)).astype(int), 1)
    idf = near_dedup.idf(counts, len(rows))
    weighted = {t: (h, c * idf[(h & np.uint64(s.buckets - 1)).astype(int)]) for t, (h, c) in bags.items()}
    root = {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for i, a in enumerate(texts):
        for b in texts[:i]:
            if len(bags[a][0]) and near_dedup.weighted_jaccard(weighted[a], weighted[b]) >= s.similarity:
                root[find(a)] = find(b)
    want = {}
    for r in rows:
        want.setdefault(find(r[1] or "") if r[1] is not None else None, set()).add((r[0] is None, r[0] or 0))
    docs = frame(spark, rows)
    kept = near_dedup.one_of_each(docs)
    assert kept.columns == docs.columns
    assert Counter((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == Counter(min(v) for v in want.values())


def test_near_copies_in_large_buckets(spark):
    """Many texts on one template, near but below the threshold, with true near copies among them."""
    rng = random.Random(9)
    prose = lambda k: [f"w{rng.randint(0, 10**9)}" for _ in range(k)]
    template, texts = prose(300), []
    for _ in range(300):
        texts.append(template + prose(rng.randint(7, 8)))
    for i in range(0, 300, 10):
        texts.append(texts[i][:-3] + prose(3))
    rows = [(i, " ".join(t), *([None] * 6)) for i, t in enumerate(texts)]
    s, hasher = near_dedup.Settings(), ByteHasher()
    bags = [near_dedup.shingles(hasher, r[1], s.words) for r in rows]
    at = lambda h: (h & np.uint64(s.buckets - 1)).astype(int)
    counts = np.bincount(np.concatenate([at(h) for h, _ in bags]), minlength=s.buckets)
    idf = near_dedup.idf(counts, len(rows))
    weighted = [(h, c * idf[at(h)]) for h, c in bags]
    first = list(range(len(rows)))
    for j in range(len(rows)):
        for i in range(j):
            if first[i] != first[j] and near_dedup.weighted_jaccard(weighted[i], weighted[j]) >= s.similarity:
                low, high = sorted((first[i], first[j]))
                first = [low if x == high else x for x in first]
    sizes = Counter(first)
    assert len(sizes) > 200 and sum(n > 1 for n in sizes.values()) >= 20
    assert {r.doc_id for r in near_dedup.one_of_each(frame(spark, rows)).collect()} == set(sizes)


def test_toxicity(spark):
    rng = random.Random(5)
    words = [f"{a}{b}um" for a in "bdfgk" for b in "aeiou"]
    rows, labels = [], []
    for i in range(240):
        bad = i % 5 == 0
        text = rng.choices(words, k=60)
        if bad:
            text[rng.randrange(60)] = rng.choice(["zorgling", "zorgmat", "zorgus"])
        rows.append((i, " ".join(text), *([None] * 6)))
        labels.append((i, int(bad)))
    rows += [(1000, None, *([None] * 6)), (1001, "you are an idi0t and a moron", *([None] * 6)), (None, "x", *([None] * 6))]
    labels += [(3, None), (None, 1)]
    docs, given = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, given)
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = {r.doc_id for r in docs.where(toxicity.held_out("doc_id")).collect()}
    right = [(scores[i] >= 0.7) == bool(y) for i, y in labels if i in held and y is not None]
    assert np.mean(right) > 0.97
    assert scores[1000] < 0.5 <= scores[1001] and all(0 <= x <= 1 for x in scores.values())
    assert docs.count() - toxicity.keep_clean(docs, model).count() == sum(x >= 0.7 for x in scores.values())


def test_automaton():
    terms, rng = ["idiot", "moron", "worthless"], random.Random(1)
    a = toxicity.Automaton(terms)

    def near(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            left, row = row, [i]
            for j, d in enumerate(y, 1):
                row.append(min(left[j] + 1, row[-1] + 1, left[j - 1] + (c != d)))
        return row[-1] <= 1

    for _ in range(600):
        w = list(rng.choice(terms))
        for _ in range(rng.randint(0, 2)):
            at = rng.randrange(len(w))
            w[at : at + rng.randint(0, 1)] = rng.choices("abimort", k=rng.randint(0, 1))
        word = "".join(w)
        assert a.match(word) == any(near(word, t) for t in terms), word


def test_automaton_of_stems():
    terms, stems, rng = ["idiot"], ["worthl", "despic"], random.Random(2)
    a = toxicity.Automaton(terms, 1, stems)

    def distance(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            left, row = row, [i]
            for j, d in enumerate(y, 1):
                row.append(min(left[j] + 1, row[-1] + 1, left[j - 1] + (c != d)))
        return row[-1]

    for _ in range(600):
        w = list(rng.choice(terms + stems) + rng.choice(["", "ess", "able", "s"]))
        for _ in range(rng.randint(0, 2)):
            at = rng.randrange(len(w))
            w[at : at + rng.randint(0, 1)] = rng.choices("cdeilostw", k=rng.randint(0, 1))
        word = "".join(w)
        near = any(distance(word[:k], s) <= 1 for s in stems for k in range(len(word) + 1))
        assert a.match(word) == (near or any(distance(word, t) <= 1 for t in terms)), word
