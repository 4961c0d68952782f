"""Layer schemas: completion, ids, labels and unions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.session import saved

REQUIRED = ("id", "class", "confidence", "source", "area_m2", "length_m", "date", "change_flag")


def keep_available(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[c for c in columns if c in df.columns])


def drop_present(df: DataFrame, *columns: str) -> DataFrame:
    return df.drop(*columns)


def sequential_id(df: DataFrame, prefix: str, order: Sequence[str | Column], scope: Sequence[str] = (), column: str = "id") -> DataFrame:
    """prefix_000000, ... by `order`, within a scope (say the scene) or over all rows. Without a scope rows are dealt to
    tasks by ranges of the order, written, and numbered from the counts of the tasks before."""
    if scope:
        return df.withColumn(column, F.format_string(f"{prefix}_%06d", F.row_number().over(Window.partitionBy(*scope).orderBy(*order)) - 1))
    dealt = saved(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "numbered")
    sizes = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))  # a row for each task
    at = F.col("__before") + F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return dealt.join(F.broadcast(before), "__part").withColumn(column, F.format_string(f"{prefix}_%06d", at)).drop("__part", "__before")


def completed(df: DataFrame, source: str, order: Sequence[str], cls: str = "building", confidence: int = 80, date: str | None = None, change_flag: str | None = None, prefix: str = "f", scope: Sequence[str] = (), geometry: str = "geom") -> DataFrame:
    """Missing class, confidence, source, date and change_flag are added; all ids are made anew if the id is missing
    or any is null (one look for a null); required columns come first, then others, the geometry last. Area and length are not made."""
    defaults = {"class": F.lit(cls), "confidence": F.lit(confidence), "source": F.lit(source), "date": F.lit(date).cast("string"), "change_flag": F.lit(change_flag).cast("string")}
    out = df.withColumns({c: v for c, v in defaults.items() if c not in df.columns})
    if "id" not in df.columns or df.filter("id is null").limit(1).count():
        out = sequential_id(out, prefix, order, scope)
    first = [c for c in REQUIRED if c in out.columns]
    last = [geometry] if geometry in out.columns else []
    return out.select(*first, *[c for c in out.columns if c not in (*first, *last)], *last)


def global_segment_id(tile_idx: Column, segment: Column) -> Column:
    return tile_idx.cast("long") * 100_000 + segment


def finite(c: Column) -> Column:
    """Null, NaN and infinities as 0."""
    x = c.cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def text_or_null(c: Column) -> Column:
    return F.when(~c.isin("None", "nan"), c)


def concat(*layers: DataFrame) -> DataFrame:
    """Union by name; columns that a layer lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), layers)


def distinct_classes(df: DataFrame, column: str = "class") -> DataFrame:
    return df.filter(F.col(column).isNotNull()).select(column).distinct().orderBy(column)


def draw(seed: int, *columns: str | Column) -> Column:
    """60 bits of the MD5 of the seed and the columns as text between bars; any engine can repeat it."""
    text = F.concat_ws("|", F.lit(str(seed)), *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def seeded_split(df: DataFrame, key: str, share: int = 8, seed: int = 42) -> DataFrame:
    """is_val for the max(1, n // share) rows of least seeded draw. Only the drawn keys are ordered, as a top-k."""
    marked = df.withColumn("__draw", draw(seed, key))
    least = max(1, df.count() // share)
    chosen = marked.select("__draw", key).orderBy("__draw", key).limit(least).select(F.col(key).alias("__key"), F.lit(True).alias("__val"))
    return marked.join(chosen, F.col(key).eqNullSafe(F.col("__key")), "left").withColumn("is_val", F.coalesce("__val", F.lit(False))).drop("__draw", "__key", "__val")


def renamed(df: DataFrame, names: dict[str, str], drop: str = "bbox-") -> DataFrame:
    """Property columns under their new names; columns that start with `drop` go."""
    return df.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in df.columns if not c.startswith(drop)])


def split_counts(scenes: DataFrame) -> DataFrame:
    return scenes.groupBy("split").agg(F.count(F.lit(1)).alias("n_scenes"))


def joined_features(features: DataFrame, pieces: DataFrame, keys: Sequence[str] = ("segment_id",)) -> DataFrame:
    """Every feature row with each of its pieces (none: nulls)."""
    return features.join(pieces, list(keys), "left")
