"""Source divergence audit: how far the word use of the sources of a language lies apart, and in which terms.

Terms are runs of ASCII letters and of characters beyond ASCII, A-Z lower-cased. In every group (lang, source) a term's
share is smoothed and scaled to whole numbers. A pair of sources starts at V times the difference of two zero counts; the
postings of an inverted index add corrections to it where a count is not zero. A term that one source of the pair has
corrects the pair by the distance of its share from the other's zero share: those come from the source's shares counted by
value, as they are the same for every term with that share. A term that both have is corrected again, in the join of
the postings, where that makes a difference. All numbers are whole and exact.

Null texts, langs and sources count as empty strings. A repeated row is one more document. Groups without terms keep their
pairs; a language without kept terms has pairs of value 0 and no term rows. An empty table gives no rows. Long texts are taken
apart in pieces between terms.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

#: Bytes to lower-case letters, bytes of characters beyond ASCII, or blanks.
_TERM_BYTES = bytes(b | 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
#: Bytes of a text that are taken apart at once, about, and entries that a task holds before it hands them on.
PIECE, HELD = 1 << 20, 500_000


def term_pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order, in lists of bounded length (but for longer single terms)."""
    data, at = text.translate(_TERM_BYTES), 0
    while at < len(data):
        end = data.find(b" ", at + PIECE) if len(data) - at > PIECE else -1
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, partly summed; the empty term marks that the group occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in held.items():
                columns = [[lang] * len(n), [source] * len(n), list(n), list(n.values()), [docs[t] for t in n]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()), strict=True)], names=["lang", "source", "term", "n", "docs"])
            held.clear()

        for batch in batches:
            for lang, source, text in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                n, docs = held.setdefault((lang.as_py(), source.as_py()), (Counter({b"": 0}), Counter()))
                own: set[bytes] = set()
                for terms in term_pieces(text.as_py()):
                    n.update(terms)
                    own.update(terms)
                docs.update(own)
            if sum(len(n) for n, _ in held.values()) > HELD:
                yield from flush()
        yield from flush()

    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = docs.select(empty("lang"), empty("source"), empty("text")).select("lang", "source", F.col("text").cast("binary"))
    return rows.mapInArrow(run, "lang string, source string, term binary, n long, docs long")


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10**9 * (n + 5) / (total + 5 * terms)), exact; null without terms."""
    whole = lambda c: c.cast("decimal(20,0)")
    over = F.call_function("div", whole(n + 5) * F.lit(10**9).cast("decimal(10,0)"), whole(total + 5 * terms))
    return F.when(terms > 0, over + 1)


def audit(docs: DataFrame, scratch: Scratch, least_docs: int = 30, terms: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank); see the module. ``least_docs``: of a language, for a term to be kept."""
    counts = term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = scratch.save(counts.withColumn("term", F.col("term").cast("string")), "counts")
    real = counts.where("term <> ''")
    kept = scratch.save(real.groupBy("lang", "term").agg(F.sum("n").alias("in_lang"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs"), "kept")
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("in_lang").alias("lang_total"))
    index = scratch.save(real.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "in_lang"), "index")
    totals = index.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("own"))
    groups = counts.where("term = ''").select("lang", "source").join(langs, "lang", "left").join(totals, ["lang", "source"], "left").fillna(0, ["terms", "lang_total", "total", "own"])
    groups = scratch.save(groups.withColumn("zero", share(F.lit(0).cast("long"), F.col("total"), F.col("terms"))), "groups")
    scratch.drop("counts")
    shares = index.join(groups, ["lang", "source"]).withColumns({"p": share(F.col("n"), F.col("total"), F.col("terms")), "q": share(F.col("in_lang"), F.col("lang_total"), F.col("terms"))})
    shares = scratch.save(shares.select("lang", "source", "term", "p", "q", "zero"), "shares")
    scratch.drop("index")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))

    words = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    words = ranked(words).where(F.col("rank") <= terms)

    left = groups.select("lang", F.col("source").alias("a"), "terms", F.col("zero").alias("zero_a"))
    right = groups.select("lang", F.col("source").alias("b"), F.col("zero").alias("zero_b"))
    pairs = left.join(right, "lang").where("a < b")
    # terms of one source: by the value of their shares, against the zero share of every other source
    by_share = shares.groupBy("lang", "source", "zero", "p").agg(F.count("*").alias("m"))
    zeros = right.select("lang", F.col("b").alias("other"), F.col("zero_b").alias("other_zero"))
    single = by_share.join(zeros, "lang").where("source <> other")
    single = single.select("lang", F.least("source", "other").alias("a"), F.greatest("source", "other").alias("b"), (F.col("m") * (F.abs(F.col("p") - F.col("other_zero")) - F.abs(F.col("zero") - F.col("other_zero")))).alias("more"))
    # terms of both: what the two corrections above leave
    one = shares.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("zero").alias("za"))
    two = shares.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"), F.col("zero").alias("zb"))
    more = F.abs(F.col("pa") - F.col("pb")) - F.abs(F.col("pa") - F.col("zb")) - F.abs(F.col("za") - F.col("pb")) + F.abs(F.col("za") - F.col("zb"))
    both = one.join(two, ["lang", "term"]).where(F.col("a") < F.col("b")).select("lang", "a", "b", more.alias("more")).where("more <> 0")
    corrections = single.where("more <> 0").unionByName(both).groupBy("lang", "a", "b").agg(F.sum("more").alias("more"))
    value = F.coalesce(F.col("terms") * F.abs(F.col("zero_a") - F.col("zero_b")), F.lit(0)) + F.coalesce("more", F.lit(0))
    pairs = scratch.save(pairs.join(corrections, ["lang", "a", "b"], "left").select("lang", "a", "b", value.cast("long").alias("value")), "pairs")
    ways = [pairs.select("lang", F.col(x).alias("source"), F.lit("pair").alias("part"), F.col(y).alias("item"), "value") for x, y in ("ab", "ba")]
    scratch.keep("shares", "pairs")
    return ranked(ways[0].unionByName(ways[1])).unionByName(words)


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), Scratch(spark, "divergence"))


OP13_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), words AS (SELECT doc, lang, source, unnest(terms) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS in_lang FROM words GROUP BY 1, 2 HAVING count(DISTINCT doc) >= 30),
langs AS (SELECT lang, count(*) AS v, sum(in_lang) AS lang_n FROM kept GROUP BY 1),
sources AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN kept k ON k.lang = w.lang AND k.term = w.term GROUP BY 1, 2, 3),
grid AS (
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, k.in_lang, l.v, l.lang_n, sum(coalesce(c.n, 0)) OVER (PARTITION BY s.lang, s.source) AS total
  FROM sources s JOIN kept k ON k.lang = s.lang JOIN langs l ON l.lang = s.lang LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term
), shares AS (
  SELECT lang, source, term, n, 1 + (CAST(1000000000 AS HUGEINT) * (n + 5)) // (total + 5 * v) AS p, 1 + (CAST(1000000000 AS HUGEINT) * (in_lang + 5)) // (lang_n + 5 * v) AS q FROM grid
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0) AS value
  FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN shares x ON x.lang = a.lang AND x.source = a.source LEFT JOIN shares y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY 1, 2, 3
), found AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q
), ranked AS (SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM found)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
"""
