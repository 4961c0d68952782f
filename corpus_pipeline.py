"""A corpus pipeline of five of the operators, each stage on all that its predecessor kept.

toxicity        documents that the classifier predicts toxic go
near_dedup      of each component of near copies (Jaccard likeness of 0.8 or more over 5-word shingles) the document with
                the least id stays
decontaminate   documents with a benchmark passage go
mix             documents are taken as often as the target mix says (0, 1 or 2 times)
shard           all rows are dealt to 16 shards; adds shard and slot

All stages but the last return the columns of `documents`; a document that the mix takes twice stands there twice, with
nothing to tell its rows apart. Each stage works on all that its predecessor kept.

Defined cases, in every stage: a null or empty text is a document like any other (not toxic unless the classifier's
bias says so, a copy of the other blank texts, clean, of size 0 and so taken only with whole passes over its source);
null ids stay and come last where the least id decides; repeated rows are copies, of which near_dedup keeps one; ties go
to the lesser id and then the lesser hash of the text; long texts are taken whole; an empty table gives an empty table;
extra columns are carried whatever their names, but for `shard` and `slot`, which the last stage replaces. Without
labels nothing is toxic, without benchmark nothing is contaminated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from geoloom.llm import decontamination, mixing, near, sharding, toxicity
from geoloom.llm.common import cut, drop_cut, table

N_SHARDS = 16


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject(docs, docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.taken(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.interleave(docs, N_SHARDS)


STAGES = [("toxicity", reject_toxic), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix_sources), ("shard", shard)]

#: SQL cannot express the classifier; tests/llm compares every stage, and their chain, with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if k:  # a stage's table is spent when the next one is written
            drop_cut(before)
    return docs
