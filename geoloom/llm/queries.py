"""The queries of this subpackage: one for each operator over its whole table, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm import chat, decontamination, langid, mixing, oracles, sharding, simhash, suffix, toxicity, urls, winnowing
from geoloom.llm.common import table


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    words = F.lit(r"\### Assistant: </turn> ok")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), words.alias("text"))
    return chat.digest(chat.format_chats(said.unionByName(probe)))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.digest(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.digest(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.digest(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_chat_format, op2_simhash, op3_sharding, op4_decontamination, op5_toxicity, op6_url_filter, op7_winnowing, op8_mixing, op9_language_id, op10_suffix_dedup)}


def oracle_sql() -> dict[str, str]:
    """The others have XXH64, a knapsack program or trained models, which DuckDB's SQL lacks; tests/llm compares them with
    brute force or measures held-out accuracy."""
    return {
        "op1_chat_format": oracles.OP1,
        "op3_sharding": oracles.op3(sharding.SEED, 16),
        "op4_decontamination": oracles.OP4,
        "op6_url_filter": oracles.op6(urls.RULES, urls.MIN_CONFIDENCE, urls.MIN_SUPPORT, urls.MIN_ROWS, urls.MAX_ITEMS),
        "op10_suffix_dedup": oracles.op10(suffix.LENGTH),
    }
