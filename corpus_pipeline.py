"""The training-data pipeline over ``documents``: quality rules, near-duplicates, secrets, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result
is written as Parquet in the shared folder and reread as the next stage's docs, and what the
stage wrote on its way is deleted. All but the last return the columns of documents; the last
returns doc_id, n_tokens and ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from formloom.llm import bpe, mixing, quality_rules, secrets, simhash
from formloom.llm.common import settled


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or their group's fences reject go."""
    return quality_rules.filtered(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the least doc_id."""
    return simhash.deduplicated(docs)


def secret_values(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are cut out of the texts, unless they are widely copied examples."""
    return secrets.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out to meet their sources' targets, in training order."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole texts become token ids."""
    return bpe.encode(docs, bpe.vocabulary(), ["doc_id"])


STAGES = [("quality rules", rules), ("near duplicates", near_duplicates), ("secrets", secret_values), ("mixing", mix), ("encoding", encode)]

#: Chains of near-duplicates and BPE are beyond SQL: a test holds run() against brute force over all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settled(spark, name.replace(" ", "-"), lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
