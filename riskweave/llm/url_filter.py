"""URL filter: a blocked Bloom filter of listed canonical URLs, then an exact hash join of the possible hits.

Listed entries are canonical ``host/path`` prefixes, each with a verdict. A URL is turned into the canonical keys that
could be listed: its host's suffixes of the label counts that occur in the list, with its path's prefixes of the lengths
that occur. The filter, of a bounded size, drops nearly all keys that are not listed; the rest meet the list in a
hash join, which removes the filter's false positives. The longest fitting entry decides; on equal lengths the longer host.

A null URL, or one without ``://``, has an empty host and path and fits no entry. Repeated rows each get a result, null
page ids too. Only the key and the URL are read; an empty table or an empty list is allowed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, mix64, table

#: The rules of the op1 contract.
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]

WORDS = 8  # 32-bit words in a block; every key sets one bit in each
_SALT = mix64(np.arange(1, WORDS + 1, dtype=U64)) | U64(1)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    url = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring({0}, instr({0}, '://') + 3)".format("_url"))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def _bits(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    block = ((h >> U64(32)) * U64(blocks)) >> U64(32)
    low = h & U64(0xFFFFFFFF)
    return block.astype(np.int64), ((low[:, None] * _SALT[None, :]) >> U64(59)).astype(np.uint32)


class BlockedBloom:
    """``blocks`` blocks of 256 bits; a key touches one block."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @staticmethod
    def build(keys: DataFrame, n: int, max_bytes: int) -> BlockedBloom:
        """Of the xxhash64 column ``h``: executors set bits, the driver gets one row a non-empty block.

        16 bits a key while that fits ``max_bytes``; beyond it the filter lets more through and the join does more work.
        """
        blocks = max(1, min(n * 16 // 256 + 1, max_bytes // 32))

        def masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                block, bit = _bits(mix64(batch.column(0).to_numpy().view(U64)), blocks)
                mask = (np.int64(1) << bit.astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(block)] + [pa.array(mask[:, w]) for w in range(WORDS)], names=["b"] + [f"w{w}" for w in range(WORDS)])

        schema = "b long, " + ", ".join(f"w{w} long" for w in range(WORDS))
        rows = keys.mapInArrow(masks, schema).groupBy("b").agg(*[F.bit_or(f"w{w}").alias(f"w{w}") for w in range(WORDS)]).toArrow()
        words = np.zeros((blocks, WORDS), np.uint32)
        for w in range(WORDS):
            words[rows.column("b").to_numpy(), w] = rows.column(f"w{w}").to_numpy().astype(np.uint32)
        return BlockedBloom(words)

    def may_have(self, h: np.ndarray) -> np.ndarray:
        block, bit = _bits(mix64(h.view(U64)), len(self.words))
        return ((self.words[block] >> bit) & 1).all(axis=1)


def list_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """(verdict, rule) pairs as the list that ``judge`` takes."""
    return spark.createDataFrame([(r, v) for v, r in rules], "rule string, verdict string")


def judge(pages: DataFrame, listed: DataFrame, key: str = "page_id", url: str = "url", otherwise: str = "allow", max_filter_bytes: int = 32 << 20) -> DataFrame:
    """One row a page: ``key``, host, path, rule (null if none fits), verdict.

    ``listed`` has rule and verdict; of equal rules the verdict first in order counts. It may be long: only its filter
    (at most ``max_filter_bytes``) is broadcast by us, the list itself is hash-joined as Spark's own size check decides.
    """
    spark = pages.sparkSession
    listed = listed.where("rule IS NOT NULL").groupBy("rule").agg(F.min("verdict").alias("listed_verdict"))
    cut = F.instr("rule", "/")
    listed = listed.withColumn("_rh", F.when(cut > 0, F.expr("substring(rule, 1, instr(rule, '/') - 1)")).otherwise(F.col("rule")))
    listed = listed.withColumn("_rp", F.expr("substring(rule, length(_rh) + 1)"))
    shape = listed.agg(
        F.count("*").alias("n"),
        F.sort_array(F.collect_set(F.size(F.split("_rh", "\\.")))).alias("labels"),  # a host has at most 127 labels
        F.sort_array(F.collect_set(F.length("_rp"))).alias("lengths"),
    ).first()
    bloom = BlockedBloom.build(listed.select(F.xxhash64("rule").alias("h")), shape["n"], max_filter_bytes)
    held = spark.sparkContext.broadcast(bloom.words)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = BlockedBloom(held.value)
        for batch in batches:
            keys, hashes = batch.column(3), batch.column(4)
            hit = bloom.may_have(hashes.flatten().to_numpy(zero_copy_only=False).astype(np.int64)) if len(hashes.flatten()) else np.zeros(0, bool)
            ends = np.concatenate(([0], np.cumsum(hit)))
            offsets = np.concatenate(([0], np.cumsum(keys.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
            found = pa.ListArray.from_arrays(pa.array(ends[offsets], pa.int32()), keys.flatten().filter(pa.array(hit)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], found], names=["_key", "host", "path", "_hits"])

    pages = pages.select(F.col(key).alias("_key"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("_url"))
    host, path = host_and_path(F.col("_url"))
    pages = pages.withColumn("host", host).withColumn("path", path).withColumn("_parts", F.split("host", "\\."))
    labels, lengths = F.array(*map(F.lit, shape["labels"])), F.array(*map(F.lit, shape["lengths"]))
    if not shape["n"]:
        keys = F.array().cast("array<string>")
    else:
        suffixes = F.transform(F.filter(labels, lambda n: n <= F.size("_parts")), lambda n: F.array_join(F.slice("_parts", -n, n), "."))
        prefixes = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substring("path", F.lit(1), n))
        keys = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))
    pages = pages.withColumn("_keys", keys)
    kind = dict(pages.dtypes)["_key"]
    pages = pages.select("_key", "host", "path", "_keys", F.transform("_keys", lambda k: F.xxhash64(k)).alias("_hashes"))
    pages = pages.mapInArrow(probe, f"_key {kind}, host string, path string, _hits array<string>")
    clean = pages.where(F.size("_hits") == 0).select("_key", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(otherwise).alias("verdict"))
    # equal (page, host, path) rows are judged once and given back as often as they came
    maybe = pages.where(F.size("_hits") > 0).groupBy("_key", "host", "path").agg(F.first("_hits").alias("_hits"), F.count("*").alias("_times"))
    keyed = maybe.select("_key", "host", "path", "_times", F.explode("_hits").alias("rule"))
    joined = keyed.join(listed.select("rule", "listed_verdict", "_rh"), "rule", "left")
    best = F.max(F.when(F.col("listed_verdict").isNotNull(), F.struct(F.length("rule").alias("n"), F.length("_rh").alias("h"), "rule", "listed_verdict")))
    judged = joined.groupBy("_key", "host", "path", "_times").agg(best.alias("b"))
    judged = judged.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int"))))
    judged = judged.select("_key", "host", "path", F.col("b.rule").alias("rule"), F.coalesce("b.listed_verdict", F.lit(otherwise)).alias("verdict"))
    return clean.unionByName(judged).withColumnRenamed("_key", key)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), list_table(spark, RULES))


def _op1_sql() -> str:
    rules = ", ".join(f"('{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{v}')" for v, r in RULES)
    return f"""
WITH rules(rule, rh, rp, v) AS (VALUES {rules}),
u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest, row_number() OVER () AS rn FROM pages),
p AS (SELECT page_id, rn, translate(regexp_extract(rest, '^([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path FROM u),
m AS (SELECT p.rn, r.rule, r.v, row_number() OVER (PARTITION BY p.rn ORDER BY length(r.rule) DESC, length(r.rh) DESC) AS k
      FROM p JOIN rules r ON (p.host = r.rh OR ends_with(p.host, '.' || r.rh)) AND starts_with(p.path, r.rp))
SELECT p.page_id, p.host, p.path, m.rule AS rule, coalesce(m.v, 'allow') AS verdict
FROM p LEFT JOIN m ON m.rn = p.rn AND m.k = 1
"""


OP1_SQL = _op1_sql()
OP7_SQL = None  # expectation-maximisation iterates; see tests/llm
