"""Scene, city and quality metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-9
COUNTED = ("house", "apartment_block")


def _f1(p: Column, r: Column, eps: float = EPS) -> Column:
    return 2 * p * r / (p + r + eps)


def object_quality(counts: DataFrame) -> DataFrame:
    """precision, recall and f1 from n_pred, n_gt, tp_pred and tp_gt."""
    p = F.when(F.col("n_pred") > 0, F.col("tp_pred") / (F.col("n_pred") + EPS)).otherwise(0.0)
    r = F.when(F.col("n_gt") > 0, F.col("tp_gt") / (F.col("n_gt") + EPS)).otherwise(0.0)
    return counts.withColumn("precision", p).withColumn("recall", r).withColumn("f1", _f1(F.col("precision"), F.col("recall")))


def with_aggregate(counts: DataFrame, key: str = "scene_id", name: str = "AGGREGATE") -> DataFrame:
    """Object counts by scene and a micro-averaged row of all; area columns of that row are null. `aggregate_last` orders
    them."""
    sums = ["n_pred", "n_gt", "tp_gt", "tp_pred", "fp", "fn"]
    total = counts.agg(*[F.sum(c).alias(c) for c in sums]).withColumn(key, F.lit(name))
    rows = counts.withColumn(key, F.col(key).cast("string")).unionByName(total, allowMissingColumns=True)
    return object_quality(rows)


def aggregate_last(rows: DataFrame, key: str = "scene_id", name: str = "AGGREGATE") -> DataFrame:
    """Rows by key with the aggregate row at the end."""
    return rows.orderBy(F.col(key) == name, key)


def area_quality(areas: DataFrame, aoi_m2: str = "aoi_m2") -> DataFrame:
    """tp, fp, fn and tn in m2 and their ratios, from area_a (predicted), area_b (reference) and area_ab."""
    a, b, ab = F.coalesce("area_a", F.lit(0.0)), F.coalesce("area_b", F.lit(0.0)), F.coalesce("area_ab", F.lit(0.0))
    out = areas.withColumn("tp_m2", ab).withColumn("fp_m2", a - ab).withColumn("fn_m2", b - ab)
    out = out.withColumn("tn_m2", F.greatest(F.lit(0.0), F.col(aoi_m2) - F.col("tp_m2") - F.col("fp_m2") - F.col("fn_m2")))
    p, r = F.col("tp_m2") / (F.col("tp_m2") + F.col("fp_m2") + EPS), F.col("tp_m2") / (F.col("tp_m2") + F.col("fn_m2") + EPS)
    total = F.col("tp_m2") + F.col("fp_m2") + F.col("fn_m2") + F.col("tn_m2")
    out = out.withColumn("area_precision", p).withColumn("area_recall", r)
    return out.withColumn("area_f1", _f1(F.col("area_precision"), F.col("area_recall"))).withColumn("area_accuracy", (F.col("tp_m2") + F.col("tn_m2")) / (total + EPS))


def scene_metrics(scenes: DataFrame, buildings: DataFrame, cars: DataFrame, cover: DataFrame, count_all: bool = False) -> DataFrame:
    """One row for each scene, with zeros for scenes without features. `scenes` has aoi_area_km2; `buildings` class
    and area_m2; `cover` class and area_m2. The total counts houses and blocks unless `count_all`."""
    km2 = F.col("aoi_area_km2")
    n_class = lambda c: F.count_if(F.col("class") == c)
    total = F.count(F.lit(1)) if count_all else n_class("house") + n_class("apartment_block")
    b = buildings.groupBy("scene_id").agg(n_class("house").alias("n_house"), n_class("apartment_block").alias("n_apartment_block"), total.alias("n_buildings_total"), F.sum("area_m2").cast("double").alias("buildings_total_area_m2"))
    c = cars.groupBy("scene_id").agg(F.count(F.lit(1)).alias("n_cars"))
    part = lambda k: F.coalesce(F.sum(F.when(F.col("class") == k, F.col("area_m2"))), F.lit(0.0)).cast("double")
    v = cover.groupBy("scene_id").agg(part("vegetation").alias("vegetation_area_m2"), part("bare_soil").alias("bare_soil_area_m2"))
    out = scenes.join(b, "scene_id", "left").join(c, "scene_id", "left").join(v, "scene_id", "left")
    out = out.na.fill(0, ["n_house", "n_apartment_block", "n_buildings_total", "buildings_total_area_m2", "n_cars", "vegetation_area_m2", "bare_soil_area_m2"])
    density = lambda n: F.when(km2 > 0, F.col(n) / km2).otherwise(0.0)
    share = lambda a: 100 * F.col(a) / (km2 * 1e6 + EPS)
    return out.withColumns({
        "buildings_density_per_km2": density("n_buildings_total"), "cars_density_per_km2": density("n_cars"),
        "buildings_share_of_aoi_pct": share("buildings_total_area_m2"), "vegetation_share_pct": share("vegetation_area_m2"), "bare_soil_share_pct": share("bare_soil_area_m2"),
    })


def rounded(metrics: DataFrame) -> DataFrame:
    """The figures as reports show them (half to even)."""
    digits = {"buildings_density_per_km2": 1, "buildings_total_area_m2": 1, "buildings_share_of_aoi_pct": 2, "cars_density_per_km2": 1, "vegetation_area_m2": 1, "vegetation_share_pct": 2, "bare_soil_area_m2": 1, "bare_soil_share_pct": 2}
    return metrics.withColumns({c: F.bround(c, n) for c, n in digits.items() if c in metrics.columns})


def segment_summary(segments: DataFrame) -> DataFrame:
    """By scene: tiles, segments, and positive and negative labels (null where the scene has no label at all)."""
    labelled = F.count("label") > 0
    return segments.groupBy("scene_id").agg(F.count_distinct("tile_idx").alias("n_tiles"), F.count(F.lit(1)).alias("n_segments"), F.when(labelled, F.count_if(F.col("label") == 1)).alias("n_pos"), F.when(labelled, F.count_if(F.col("label") == 0)).alias("n_neg"))


def building_summary(buildings: DataFrame) -> DataFrame:
    return buildings.groupBy("scene_id").agg(F.count(F.lit(1)).alias("n_buildings_total"), F.count_if(F.col("class") == "house").alias("n_house"), F.count_if(F.col("class") == "apartment_block").alias("n_apartment_block"), F.sum("area_m2").alias("total_area_m2"), F.avg("area_m2").alias("mean_area_m2"), F.avg("confidence").alias("mean_confidence"))


def city_summary(metrics: DataFrame) -> DataFrame:
    concrete = F.col("buildings_share_of_aoi_pct") - F.col("vegetation_share_pct")
    return metrics.groupBy("city").agg(
        F.count(F.lit(1)).alias("scenes"), F.sum("aoi_area_km2").alias("area_km2"), F.sum("n_buildings_total").alias("buildings"), F.sum("n_house").alias("houses"), F.sum("n_apartment_block").alias("blocks"), F.sum("n_cars").alias("cars"),
        F.avg("cars_density_per_km2").alias("cars_per_km2"), F.avg("buildings_share_of_aoi_pct").alias("buildings_pct"), F.avg("vegetation_share_pct").alias("vegetation_pct"), F.avg("bare_soil_share_pct").alias("soil_pct"), F.avg(concrete).alias("concrete"),
    )


def totals(metrics: DataFrame) -> DataFrame:
    """Totals over all scenes, and the composition by area; other is what remains of 100."""
    area = F.sum(F.col("aoi_area_km2") * 1e6)
    pct = {n: 100 * F.sum(c) / area for n, c in (("buildings_pct", "buildings_total_area_m2"), ("vegetation_pct", "vegetation_area_m2"), ("soil_pct", "bare_soil_area_m2"))}
    out = metrics.agg(F.sum("n_buildings_total").alias("buildings"), F.sum("n_cars").alias("cars"), F.sum("aoi_area_km2").alias("area_km2"), *[v.alias(k) for k, v in pct.items()])
    return out.withColumn("other_pct", 100 - F.col("buildings_pct") - F.col("vegetation_pct") - F.col("soil_pct"))


def class_distribution(buildings: DataFrame) -> DataFrame:
    return buildings.filter("class is not null").groupBy("class").agg(F.count(F.lit(1)).alias("n"))


COMPARED = {"buildings": False, "cars": False, "cars_per_km2": False, "buildings_pct": False, "vegetation_pct": False, "soil_pct": False, "concrete": True}


def compare_cities(summary: DataFrame, a: str, b: str, lower_is_better: dict[str, bool] = COMPARED) -> DataFrame:
    """metric, a, b, delta, better (A, B or =), bar widths against the larger magnitude, decimals of the delta."""
    names = list(lower_is_better)
    rows = summary.filter(F.col("city").isin(a, b)).select("city", F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value"), F.lit(lower_is_better[n]).alias("low")) for n in names])).alias("m")).select("city", "m.*")
    wide = rows.groupBy("metric", "low").agg(F.max(F.when(F.col("city") == a, F.col("value"))).alias("a"), F.max(F.when(F.col("city") == b, F.col("value"))).alias("b"))
    top = F.greatest(F.abs("a"), F.abs("b"))
    scale = F.when(top > 0, top).otherwise(1.0)
    delta = F.col("a") - F.col("b")
    ahead = F.when(F.col("low"), -delta).otherwise(delta)
    return wide.select("metric", "a", "b", delta.alias("delta"), F.when(ahead > 0, "A").when(ahead < 0, "B").otherwise("=").alias("better"), (F.abs("a") / scale).alias("bar_a"), (F.abs("b") / scale).alias("bar_b"), F.when(F.abs(delta) >= 1, 1).otherwise(2).alias("decimals"))


#: category: (figure, ascending)
TOP = {"traffic": ("cars_density_per_km2", False), "density": ("building_density", False), "green": ("vegetation_share_pct", False), "concrete": ("concrete_score", False), "green_belt": ("concrete_score", True)}


def top_scenes(metrics: DataFrame, n: int = 3) -> DataFrame:
    """The first n scenes of each category; ties by scene."""
    rows = metrics.withColumn("concrete_score", F.col("buildings_share_of_aoi_pct") - F.col("vegetation_share_pct")).withColumn("building_density", F.col("n_buildings_total") / F.col("aoi_area_km2"))
    ways = F.array(*[F.struct(F.lit(k).alias("category"), F.col(c).alias("value"), (F.col(c) if up else -F.col(c)).alias("order")) for k, (c, up) in TOP.items()])
    long = rows.select("scene_id", "city", F.explode(ways).alias("w")).select("scene_id", "city", "w.*")
    rank = F.row_number().over(Window.partitionBy("category").orderBy("order", "scene_id"))
    return long.withColumn("place", rank).filter(F.col("place") <= n).drop("order")


def peak(metrics: DataFrame, by: str) -> DataFrame:
    return metrics.orderBy(F.desc(by), "scene_id").limit(1)


def pixel_quality(pairs: DataFrame, keys: list[str], pred: str = "pred", truth: str = "truth", eps: float = 1e-6) -> DataFrame:
    p, t = F.col(pred).cast("long"), F.col(truth).cast("long")
    out = pairs.groupBy(*keys).agg(F.sum(p * t).alias("tp"), F.sum(p * (1 - t)).alias("fp"), F.sum((1 - p) * t).alias("fn"))
    return out.withColumn("f1", 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn") + eps)).withColumn("iou", F.col("tp") / (F.col("tp") + F.col("fp") + F.col("fn") + eps))


def segmentation_loss(pixels: DataFrame, sample: str, logit: str, truth: str, dice_weight: float = 0.5, smooth: float = 1.0) -> DataFrame:
    """Binary cross entropy over all pixels plus `dice_weight` times the mean over samples of 1 - Dice."""
    x, t = F.col(logit), F.col(truth).cast("double")
    p = 1 / (1 + F.exp(-x))
    bce = F.greatest(x, F.lit(0.0)) - x * t + F.log1p(F.exp(-F.abs(x)))
    per = pixels.groupBy(sample).agg(F.sum(bce).alias("bce"), F.count(F.lit(1)).alias("n"), F.sum(p * t).alias("pt"), F.sum(p + t).alias("s"))
    dice = (2 * F.col("pt") + smooth) / (F.col("s") + smooth)
    return per.agg((F.sum("bce") / F.sum("n") + dice_weight * F.avg(1 - dice)).alias("loss"), F.avg(dice).alias("dice"), (F.sum("bce") / F.sum("n")).alias("bce"))


def mean_loss(steps: DataFrame, keys: Sequence[str] = ("epoch",), loss: str = "loss", n: str = "n") -> DataFrame:
    """Mean loss of the samples of each epoch, from the mean loss and the samples of each step."""
    return steps.groupBy(*keys).agg((F.sum(F.col(loss) * F.col(n)) / F.greatest(F.sum(n), F.lit(1))).alias("train_loss"))


def city_peaks(metrics: DataFrame, by: str = "n_cars") -> DataFrame:
    """By city the mean figures and the scene with most of `by` (ties: least scene), busiest city first."""
    best = F.max(F.struct(F.col(by).alias("v"), (-F.col("scene_id")).alias("s"))).alias("best")
    out = metrics.groupBy("city").agg(F.avg(by).alias("mean"), F.avg("buildings_density_per_km2").alias("mean_density"), best)
    return out.select("city", "mean", "mean_density", (-F.col("best.s")).alias("peak_scene"), F.col("best.v").alias("peak")).orderBy(F.desc("mean"), "city")


def percent(x: Column, digits: int = 1) -> Column:
    """12.3%, with a true minus."""
    return F.concat(F.replace(F.format_number(x, digits), F.lit("-"), F.lit("−")), F.lit("%"))


def spaced(n: Column) -> Column:
    """1 234 567, with a true minus."""
    return F.replace(F.replace(F.format_number(n, 0), F.lit(","), F.lit(" ")), F.lit("-"), F.lit("−"))
