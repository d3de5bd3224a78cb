"""Corpus preparation: from raw documents to token blocks, each stage one operator over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from landloom.llm.common import materialise, table
from landloom.llm.decontaminate import clean
from landloom.llm.mixing import mixed
from landloom.llm.near_copies import keep_distinct
from landloom.llm.quality_rules import keep
from landloom.llm.token_output import token_output


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, Jaccard 0.8) stays."""
    return keep_distinct(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and in such parts, as the source mix takes them."""
    return mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token blocks are written in the shared folder; one digest row per row, read back from them."""
    return token_output(docs)


STAGES = [
    ("quality rules", quality),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token output", tokens),
]

#: Signatures, hashes and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
