"""Queries of the training-data operators over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entityflow.llm import chat, decontaminate, langid, licenses, mixing, neardup, oracles, quality_model, quality_rules, sharding, substrings
from entityflow.llm.common import materialize


def _read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", "doc_id", "text")
    items = _read(spark, sf_dir, "benchmark", "item_id", "text")
    found = decontaminate.decontaminate(docs, items)
    digest = F.sha2(F.array_join("item_ids", ","), 256)
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["first"], s["last"])), ",")
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated", spans.alias("spans"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", "doc_id", "source", "text")
    return mixing.mix(docs)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return langid.identify(docs).select("doc_id", "held_out", "lang_pred", "score", "languages", "proportions")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", "doc_id", "text")
    labels = _read(spark, sf_dir, "labels", "doc_id", "quality")
    return quality_model.classify(docs, labels).select("doc_id", "held_out", "score", "predicted")


def op5_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return chat.link(chat.from_turns(turns), schemas=chat.ANSWER)


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_read(spark, sf_dir, "documents", "doc_id", "text"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", "doc_id", "text")
    return licenses.scan_licenses(docs).select("doc_id", *licenses.RESULT)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", "doc_id", "text")
    return sharding.assign(docs).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op9_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", "doc_id", "text")
    found = substrings.remove_repeats(docs, texts=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", "doc_id", "source", "text")
    measured = materialize(quality_rules.measure(docs).drop("text"), "rules")
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality_rules.judge(measured).select("doc_id", *columns)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    all_queries = (
        op1_decontamination,
        op2_mixing,
        op3_language_id,
        op4_quality_classifier,
        op5_tool_call_linking,
        op6_near_duplicates,
        op7_license_scan,
        op8_sharding,
        op9_repeated_substrings,
        op10_quality_rules,
    )
    return {f.__name__: f for f in all_queries}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
