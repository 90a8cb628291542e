"""A training corpus from ``documents``: five stages, each over all that the one before kept.

Each function takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in the shared folder
and reads it back as the next stage's docs, so a lost executor repeats one stage's tasks and no more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from entityflow.llm import decontaminate, mixing, neardup, quality_rules, sharding
from entityflow.llm.common import materialize

#: Near-duplicate classes, hashes of words and numerical draws are not expressible in SQL over whole tables.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no rule and whose host is not rejected."""
    judged = quality_rules.judge(materialize(quality_rules.measure(docs), "measured"))
    return judged.filter("kept").select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return neardup.deduplicate(docs).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.decontaminate(docs, benchmark, spans=False).filter("not contaminated").select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out by their source's rate, in shuffled order."""
    return mixing.mix(docs).select(docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and their place in it."""
    return sharding.assign(docs)


STAGES = [
    ("quality_rules", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mix),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
