"""The corpus pipeline: quality, exact copies, near copies, mixing, encoding.

Each stage takes ``(spark, docs, sf_dir)``, where ``docs`` is what its predecessor wrote, and acts on
all of it; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from oddsmith.llm import bpe, exact_dedup, mixing, near_dups, quality
from oddsmith.llm._shared import fresh_path, landed, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, by a digest index of this run."""
    index = exact_dedup.DigestIndex.open(spark, fresh_path(spark, "pipeline-digests"))
    return exact_dedup.deduplicate(docs, index, "pipeline")


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words, similarity 0.8."""
    return near_dups.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document comes as often as it is taken."""
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and decoded texts of what is left."""
    return bpe.encode_report(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", without_copies),
    ("near-duplicates", without_near_copies),
    ("mixing", mixed),
    ("encoding", encoded),
]
# The classifier, MinHash and the tokenizer are beyond SQL; tests hold the stages against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = landed(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
