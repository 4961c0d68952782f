"""Sharding by proportional stratified interleaving (law `rows`: shard counts are at most one apart).

The rows of each source are shuffled by a seeded hash (the first 15 hex digits of an MD5) and ranked; row r of a source of n rows has the fractional
rank (2r+1)/2n. Sorted by it, every stretch of the order holds each source in proportion, so cutting the order
into equal stretches gives shards that match the mixture. Both ranks are taken in cells (of the hash's high
bits, then of the fractional rank), never in one task per source or one sorted partition.

Defined cases: a null source is a stratum of its own; a null text has size 1 and the checksum of the empty
string; null ids are ordered first; equal rows take places next to each other in any order; an empty table
gives an empty result; extra columns are carried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoloom.llm.common import CELL_ROWS, cut, drawn, packed, salt_bits, salted_rank

SEED = 20_240_601


def interleave(docs: DataFrame, n_shards: int, source: str = "source", ids: tuple[str, ...] = ("doc_id",), seed: int = SEED, cell_rows: int = CELL_ROWS) -> DataFrame:
    """`docs` with shard (int) and slot (long, gapless from 0 in each shard); columns of these names are replaced."""
    rows = docs.count()
    cells = max(1, -(-rows // cell_rows))
    named = [F.col(f"`{c}`").alias(f"__id{k}") for k, c in enumerate(ids)]
    marked = docs.select(packed(docs, "shard", "slot"), F.col(source).isNull().alias("__none"), F.coalesce(source, F.lit("")).alias("__source"), drawn(seed, *[F.col(f"`{c}`") for c in ids]).alias("__draw"), *named)
    ranked = salted_rank(marked, ["__none", "__source"], "__draw", [f"__id{k}" for k in range(len(ids))], "__rank", "__of", salt_bits(rows, cell_rows))
    part = (2 * F.col("__rank") + 1) / (2 * F.col("__of"))
    ranked = ranked.withColumn("__part", part).withColumn("__slice", F.least(F.floor(F.col("__part") * cells), F.lit(cells - 1)))
    counts = ranked.groupBy("__slice").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)  # one row for each cell of rows
    offsets = counts.select("__slice", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy("__slice").orderBy("__part", "__none", "__source", "__rank")
    placed = ranked.withColumn("__in", F.row_number().over(within)).join(offsets, "__slice").withColumn("__at", F.col("__before") + F.col("__in") - 1)
    placed = placed.withColumn("shard", F.expr(f"cast(__at * {n_shards} div {max(rows, 1)} as int)"))
    first = F.expr(f"(shard * {rows}L + {n_shards - 1}L) div {n_shards}L")
    return placed.select("__row.*", "shard", (F.col("__at") - first).alias("slot"))


def digest(documents: DataFrame, n_shards: int = 16) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    narrow = documents.select("doc_id", "source", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    narrow = cut(narrow, "sharding")  # texts are read once
    out = interleave(narrow, n_shards, ids=("doc_id", "text_crc32", "size"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
