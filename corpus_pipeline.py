"""The corpus pipeline: five stages over ``documents``, each applying one corpus operator to all that the one before kept.

toxicity drops documents that score 0.7 or more; line_dedup removes repeated lines, and documents made of nothing else;
near_dedup keeps one document of each class of near copies; mixing takes words of each source near its target weight;
bpe encodes what is left and decodes it again. Null or empty texts pass all stages except mixing, which takes no words
from them; empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm import bpe, line_dedup, mixing, near_dedup, toxicity
from riskweave.llm.common import Scratch, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below 0.7; the model is fitted on the labels beside the tables."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines."""
    return line_dedup.without_lines(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return near_dedup.one_of_each(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as documents: a document drawn in two passes occurs twice, undrawn words are left out."""
    return mixing.mixed_documents(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (packed little-endian unsigned 32-bit) and the text decoded from them."""
    import public_tokenizers

    out = bpe.transcode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", "ids", F.decode("decoded", "UTF-8").alias("text"))


STAGES = [("toxicity", toxicity_stage), ("line_dedup", line_stage), ("near_dedup", near_stage), ("mixing", mixing_stage), ("bpe", bpe_stage)]
#: Sampling, components and tokenisation are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each one's result written and read again as the next one's input."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
