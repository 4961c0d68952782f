"""Per-segment features: colour and mask shares by aggregation, texture by neighbour pairs, shape by moments."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoloom.functions import kernels
from geoloom.functions import pixels as px

GLCM = ("glcm_contrast", "glcm_homogeneity", "glcm_asm", "glcm_correlation", "glcm_dissimilarity")
LEVELS, MIN_PIXELS = 32, 4


def with_masks(pixels: DataFrame) -> DataFrame:
    """Pixels (r, g, b, valid) with veg, dark and bare, and the class by priority."""
    b = [F.col(c) for c in ("r", "g", "b", "valid")]
    out = pixels.withColumn("veg", px.vegetation(*b)).withColumn("dark", px.shadow(*b)).withColumn("bare", px.soil(*b))
    return out.withColumn("cover", px.prioritized(F.col("veg"), F.col("dark"), F.col("bare")))


def cleaned(mask: Column, width: Column, radius: int = 3) -> Column:
    """A tile's mask (an array of booleans, row by row) opened and then closed by a disk. Tiles stay rows: nothing is
    shuffled, and tiles of one shape are worked on together."""

    @F.arrow_udf("array<boolean>")
    def run(masks: pa.Array, widths: pa.Array) -> pa.Array:
        flat, at, w = masks.values.to_numpy(zero_copy_only=False).astype(bool), masks.offsets.to_numpy(), widths.to_numpy(zero_copy_only=False).astype(int)
        size = np.diff(at)
        out = np.zeros(len(flat), bool)
        for shape in set(zip(size.tolist(), w.tolist())):
            if shape[0]:
                which = np.flatnonzero((size == shape[0]) & (w == shape[1]))
                places = at[which][:, None] + np.arange(shape[0])
                planes = flat[places].reshape(len(which), -1, shape[1])
                out[places] = kernels.closed(kernels.opened(planes, radius), radius).reshape(len(which), -1)
        return pa.ListArray.from_arrays(pa.array(at - at[0], pa.int32()), pa.array(out[at[0] : at[-1]]))

    return run(mask, width)


def masked_pixels(tiles: DataFrame, keys: list[str], radius: int = 3) -> DataFrame:
    """Tile rows (keys, width, arrays r, g, b, valid row by row) to pixel rows with veg, dark and bare, each opened and
    closed by a disk as whole masks, and the class by priority. `radius` 0 leaves the masks as they are."""
    bands = F.arrays_zip("r", "g", "b", "valid")
    out = tiles.select(*keys, "width", "r", "g", "b", "valid")

    def over_tile(mask) -> Column:
        return F.transform(bands, lambda p: F.coalesce(mask(p["r"], p["g"], p["b"], p["valid"]), F.lit(False)))

    for name, mask in (("veg", px.vegetation), ("dark", px.shadow), ("bare", px.soil)):
        out = out.withColumn(name, cleaned(over_tile(mask), F.col("width"), radius) if radius else over_tile(mask))
    cells = out.select(*keys, "width", F.posexplode(F.arrays_zip("r", "g", "b", "valid", "veg", "dark", "bare")).alias("pos", "p")).select(*keys, "pos", F.floor(F.col("pos") / F.col("width")).alias("prow"), (F.col("pos") % F.col("width")).cast("long").alias("pcol"), "p.*")
    return cells.withColumn("cover", px.prioritized(F.col("veg"), F.col("dark"), F.col("bare")))


def color_features(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """18 colour features (population deviations; hue averaged arithmetically) and the three mask shares."""
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    h, s, v = px.hsv(r, g, b)
    bands = {"r": r, "g": g, "b": b, "h": h, "s": s, "v": v, "intensity": px.intensity(r, g, b)}
    aggs = [f(c).alias(f"{n}_{m}") for n, c in bands.items() for m, f in (("mean", F.avg), ("std", F.stddev_pop))]
    index = {"exg": px.excess_green, "v_idx": px.color_invariance, "cive": px.cive, "vig": px.vig}
    aggs += [F.avg(f(r, g, b)).alias(f"{n}_mean") for n, f in index.items()]
    masks = {"frac_vegetation": "veg", "frac_shadow": "dark", "frac_soil": "bare"}
    first = px.prioritized(F.col("veg"), F.col("dark"), F.col("bare"))
    names = {"veg": "vegetation", "dark": "shadow", "bare": "soil"}
    aggs += [F.avg(F.coalesce(first == names[c], F.lit(False)).cast("double")).alias(n) for n, c in masks.items()]
    return pixels.groupBy(*keys).agg(*aggs)


def glcm(pixels: DataFrame, keys: list[str], level: Column, row: str = "prow", col: str = "pcol") -> DataFrame:
    """Symmetric, normed co-occurrence of horizontal neighbours of full tiles: contrast, homogeneity, asm,
    correlation (1 for a constant tile) and dissimilarity. `level` is the quantised intensity."""
    beside = Window.partitionBy(*keys, row).orderBy(col)
    pairs = pixels.select(*keys, row, col, level.alias("i")).withColumn("j", F.lead("i").over(beside)).filter("j is not null")
    both = pairs.select(*keys, F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).alias("p")).select(*keys, "p.*")
    cells = both.groupBy(*keys, "i", "j").agg(F.count(F.lit(1)).alias("n"))
    d, n = (F.col("i") - F.col("j")).cast("double"), F.col("n").cast("double")
    i, j = F.col("i").cast("double"), F.col("j").cast("double")
    t = F.sum(n)
    sums = cells.groupBy(*keys).agg(
        (F.sum(n * d * d) / t).alias("glcm_contrast"), (F.sum(n / (1 + d * d)) / t).alias("glcm_homogeneity"), (F.sum(n * n) / (t * t)).alias("glcm_asm"),
        (F.sum(n * F.abs(d)) / t).alias("glcm_dissimilarity"), (F.sum(n * i) / t).alias("__m"), (F.sum(n * i * i) / t).alias("__q"), (F.sum(n * i * j) / t).alias("__c"),
    )
    var = F.col("__q") - F.col("__m") * F.col("__m")
    return sums.withColumn("glcm_correlation", F.when(var < 1e-15, 1.0).otherwise((F.col("__c") - F.col("__m") * F.col("__m")) / var)).drop("__m", "__q", "__c")


def shape_features(pixels: DataFrame, keys: list[str], row: str = "prow", col: str = "pcol") -> DataFrame:
    """area, extent, axes, eccentricity and orientation of segments from second moments (1/12 for the pixel)."""
    r, c = F.col(row).cast("double"), F.col(col).cast("double")
    m = pixels.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("area_px"), (F.var_pop(r) + 1 / 12).alias("__rr"), (F.var_pop(c) + 1 / 12).alias("__cc"), F.covar_pop(r, c).alias("__rc"),
        (F.count(F.lit(1)) / ((F.max(r) - F.min(r) + 1) * (F.max(c) - F.min(c) + 1))).alias("extent"),
    )
    rr, cc, rc = F.col("__rr"), F.col("__cc"), F.col("__rc")
    root = F.sqrt((rr - cc) * (rr - cc) + 4 * rc * rc)
    big, small = (rr + cc + root) / 2, F.greatest((rr + cc - root) / 2, F.lit(0.0))
    turn = F.when(rr == cc, F.when(rc < 0, math.pi / 4).otherwise(-math.pi / 4)).otherwise(0.5 * F.atan2(2 * rc, rr - cc))
    return m.withColumns({
        "major_axis_len": 4 * F.sqrt(big), "minor_axis_len": 4 * F.sqrt(small),
        "eccentricity": F.when(big == 0, 0.0).otherwise(F.sqrt(1 - small / big)), "orientation": turn,
    }).drop("__rr", "__cc", "__rc")


def with_compactness(features: DataFrame, area: str = "area_px", perimeter: str = "perimeter_px", eps: float = 1e-6) -> DataFrame:
    a, p = F.col(area), F.col(perimeter)
    return features.withColumn("shape_index", p / (4 * F.sqrt(a + eps))).withColumn("compactness", 4 * math.pi * a / (p * p + eps))


TILE_SCHEMA = "segment_id int, perimeter_px double, solidity double, " + ", ".join(f"{n} double" for n in GLCM) + ", " + ", ".join(f"lbp_h{i} double" for i in range(10))


def texture_and_outline(pixels: DataFrame, keys: list[str], segment: str = "segment_id", row: str = "prow", col: str = "pcol") -> DataFrame:
    """By tile and segment: perimeter, solidity, co-occurrence and local binary pattern figures of the segment's
    bounding box (outside pixels take the segment's mean). One tile is one group; tiles bound its size."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r, c = pdf[row].to_numpy() - pdf[row].min(), pdf[col].to_numpy() - pdf[col].min()
        shape = (int(r.max()) + 1, int(c.max()) + 1)
        light, label = np.zeros(shape), np.zeros(shape, int)
        light[r, c] = pdf[["r", "g", "b"]].to_numpy(float).mean(1)
        label[r, c] = pdf[segment].to_numpy()
        rows = [{"segment_id": k, **kernels.segment_texture(light, label == k)} for k in np.unique(label) if k > 0]
        out = pd.DataFrame(rows, columns=[x.split()[0] for x in TILE_SCHEMA.split(", ")])
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out

    types = dict(pixels.dtypes)
    return pixels.groupBy(*keys).applyInPandas(run, TILE_SCHEMA + "".join(f", {k} {types[k]}" for k in keys))


def _plane(pdf: pd.DataFrame, value: str, row: str, col: str, dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r, c = pdf[row].to_numpy() - pdf[row].min(), pdf[col].to_numpy() - pdf[col].min()
    out = np.zeros((int(r.max()) + 1, int(c.max()) + 1), dtype)
    out[r, c] = pdf[value].to_numpy()
    return out, r, c


def superpixels(pixels: DataFrame, keys: list[str], n_segments: int = 200, compactness: float = 15.0, row: str = "prow", col: str = "pcol") -> DataFrame:
    """Pixels with segment_id (0 where not valid), by local k-means in colour and place, tile by tile."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        valid, r, c = _plane(pdf, "valid", row, col, bool)
        rgb = np.stack([_plane(pdf, b, row, col, float)[0] for b in "rgb"], -1)
        return pdf.assign(segment_id=kernels.superpixels(rgb, valid, n_segments, compactness)[r, c].astype("int32"))

    return pixels.groupBy(*keys).applyInPandas(run, T.StructType([*pixels.schema.fields, T.StructField("segment_id", T.IntegerType())]))


def polygons(pixels: DataFrame, keys: list[str], segment: str = "segment_id", row: str = "prow", col: str = "pcol") -> DataFrame:
    """keys, segment_id, piece and the rings of each 4-connected piece of a label, in pixel corners."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        label, r, c = _plane(pdf, segment, row, col, int)
        r0, c0 = int(pdf[row].min()), int(pdf[col].min())
        rows = [{"segment_id": k, "piece": i, "rings": [[{"x": float(x + c0), "y": float(y + r0)} for x, y in ring] for ring in rings]} for k, i, rings in kernels.trace(label)]
        out = pd.DataFrame(rows, columns=["segment_id", "piece", "rings"])
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out

    types = dict(pixels.dtypes)
    return pixels.groupBy(*keys).applyInPandas(run, "segment_id int, piece int, rings array<array<struct<x:double,y:double>>>" + "".join(f", {k} {types[k]}" for k in keys))
