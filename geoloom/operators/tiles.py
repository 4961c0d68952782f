"""Tile and patch grids as exploded sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.operators import schema


def tiles(scenes: DataFrame, tile: int = 1024, overlap: int = 128) -> DataFrame:
    """tile_idx (row-major), col_off, row_off, width, height; edge tiles are cut, slivers inside the overlap stay."""
    if overlap >= tile:
        raise ValueError("overlap must be smaller than tile")
    step = tile - overlap
    rows = scenes.withColumn("row_off", F.explode(F.sequence(F.lit(0).cast("long"), F.col("height_px") - 1, F.lit(step).cast("long"))))
    cells = rows.withColumn("col_off", F.explode(F.sequence(F.lit(0).cast("long"), F.col("width_px") - 1, F.lit(step).cast("long"))))
    across = F.ceil(F.col("width_px") / step)
    return cells.withColumn("tile_idx", (F.col("row_off") / step).cast("long") * across + (F.col("col_off") / step).cast("long")).withColumn("width", F.least(F.lit(tile), F.col("width_px") - F.col("col_off"))).withColumn("height", F.least(F.lit(tile), F.col("height_px") - F.col("row_off")))


def owned(prow: Column, pcol: Column, tile_row: Column, tile_col: Column, overlap: int = 128) -> Column:
    """Whether a tile's pixel (row and column in the tile) belongs to it when overlaps go to the earlier tile; without
    this filter pixels of an overlap count in both tiles."""
    return ((tile_row == 0) | (prow >= overlap)) & ((tile_col == 0) | (pcol >= overlap))


def n_tiles(width: Column, height: Column, tile: int = 1024, overlap: int = 128) -> Column:
    return F.ceil(width / (tile - overlap)) * F.ceil(height / (tile - overlap))


def _starts(size: Column, patch: int, stride: int) -> Column:
    """Aligned starts and the last one at the edge; none where the scene is smaller than a patch."""
    last = size - patch
    return F.when(last >= 0, F.array_distinct(F.concat(F.sequence(F.lit(0).cast("long"), last, F.lit(stride).cast("long")), F.array(last)))).otherwise(F.array().cast("array<bigint>"))


def patches(scenes: DataFrame, patch: int = 256, stride: int = 192) -> DataFrame:
    """col and row of the inference patches: the aligned grid, the right and bottom edges and the corner, once each."""
    return scenes.withColumn("row", F.explode(_starts(F.col("height_px"), patch, stride))).withColumn("col", F.explode(_starts(F.col("width_px"), patch, stride)))


def training_tiles(scenes: DataFrame, tile: int = 1024, patch: int = 256) -> DataFrame:
    return tiles(scenes, tile, 0).filter((F.col("width") >= patch) & (F.col("height") >= patch))


def crop_offset(size: Column, patch: int, seed: int, *ids: str, centre: bool = False) -> Column:
    """A seeded random, or the central, start of a crop."""
    room = F.greatest(size - patch, F.lit(0))
    return F.floor(room / 2).cast("long") if centre else schema.draw(seed, *ids) % (room + 1)


def dataset_length(n: Column, patches_per_tile: int, training: bool) -> Column:
    return n * patches_per_tile if training else n


def shift_grid(df_session, n: int = 16, step: float = 0.05) -> DataFrame:
    """factor_lat and factor_lon of an n x n grid."""
    axis = df_session.range(n)
    return axis.select((F.col("id") * step).alias("factor_lat"), F.col("id").alias("i")).crossJoin(axis.select((F.col("id") * step).alias("factor_lon"), F.col("id").alias("j")))


def padded_bounds(boxes: DataFrame, keys: list[str], pad: float = 0.002) -> DataFrame:
    return boxes.groupBy(*keys).agg((F.min("x0") - pad).alias("x0"), (F.min("y0") - pad).alias("y0"), (F.max("x1") + pad).alias("x1"), (F.max("y1") + pad).alias("y1"))


def good_tiles(pixels: DataFrame, keys: list[str], min_valid: int = 1000, min_mean: float = 5.0) -> DataFrame:
    """Tiles with enough valid pixels that are not black on the whole (mean over bands and all pixels)."""
    stats = pixels.groupBy(*keys).agg(F.count_if("valid").alias("n_valid"), (F.avg(F.col("r") + F.col("g") + F.col("b")) / 3).alias("mean_rgb"), F.avg(F.col("valid").cast("double")).alias("valid_share"))
    return stats.filter((F.col("n_valid") >= min_valid) & (F.col("mean_rgb") >= min_mean))


def good_patches(pixels: DataFrame, keys: list[str], min_share: float) -> DataFrame:
    return pixels.groupBy(*keys).agg(F.avg(F.col("valid").cast("double")).alias("valid_share")).filter(F.col("valid_share") >= min_share)


def steady_mean(value: str) -> Column:
    """The mean of doubles, the same in whatever order they are added, so that ties of a later rounding do not hang on the
    partitioning: whole steps of 2**-60 are summed and the mean has 15 decimals. Groups with a value above 4 in size or NaN get the
    plain mean."""
    v = F.col(value).cast("double")
    fits = F.abs(v) <= 4
    steps = F.when(fits, (v * 2.0**60).cast("long"))
    high, low = F.shiftright(steps, 30), steps.bitwiseAND(2**30 - 1)
    n = F.count(steps)
    mean = F.sum(high) / n * 2.0**-30 + F.sum(low) / n * 2.0**-60
    return F.when(F.count_if(~fits) > 0, F.avg(v)).when(n > 0, F.round(mean, 15))


def mosaic(probabilities: DataFrame, keys: list[str], value: str = "p", threshold: float = 0.5) -> DataFrame:
    """Overlapping patches averaged by place, and whether the place is positive."""
    return probabilities.groupBy(*keys).agg(steady_mean(value).alias("p"), F.count(F.lit(1)).alias("n")).withColumn("positive", F.col("p") >= threshold)
