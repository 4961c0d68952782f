"""Learning stages: random forests on segment features, shift calibration, and pluggable network inference.

Networks themselves are outside the library: inference takes any function from patches to probabilities.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoloom.functions import geometry as geo
from geoloom.operators import spatial
from geoloom.operators.schema import finite
from geoloom.session import saved

#: The fixed parameters of the segment classifier.
FOREST = {"numTrees": 80, "maxDepth": 18, "minInstancesPerNode": 10, "seed": 42}


def balanced(df: DataFrame, label: str = "label") -> DataFrame:
    """`weight` of a row: rows / (classes x rows of its class)."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    t = n.agg(F.sum("__n").alias("__t"), F.count(F.lit(1)).alias("__k"))
    return df.join(n.crossJoin(t).select(label, (F.col("__t") / (F.col("__k") * F.col("__n"))).alias("weight")), label)  # two rows and one


def vectors(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features").transform(df.withColumns({c: finite(F.col(c)) for c in features}))


def train_forest(df: DataFrame, features: list[str], label: str = "label", **params) -> RandomForestClassificationModel:
    return RandomForestClassifier(featuresCol="features", labelCol=label, weightCol="weight", **(FOREST | params)).fit(balanced(vectors(df, features), label))


def cross_validated(df: DataFrame, features: list[str], key: str, label: str = "label", folds: int = 3, **params) -> DataFrame:
    """accuracy, precision, recall and f1 on rows that no tree of their fold saw. Forests here keep no out-of-bag
    votes, so folds by a hash of `key` stand for them."""
    rows = df.withColumn("__fold", F.pmod(F.xxhash64(key), F.lit(folds)))
    parts = []
    for k in range(folds):
        model = train_forest(rows.filter(F.col("__fold") != k), features, label, **params)
        parts.append(model.transform(vectors(rows.filter(F.col("__fold") == k), features)).select(label, "prediction"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    y, p = F.col(label) == 1, F.col("prediction") == 1
    c = every.agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select(((tp + tn) / (tp + fp + fn + tn)).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def _shifted(segments: DataFrame, refs: DataFrame, shifts: DataFrame, *keys: str) -> DataFrame:
    """(`keys` of the distinct boxes of segments, dx, dy, shared, n): the area that a box, or with no keys all segments,
    shares with the references moved by each (dx, dy) of the grid `shifts`, of fixed size; n segments have the box.

    Equal boxes of a scene are joined once and count by their number, references once, widened by the farthest shifts; a
    pair's shared widths by dx and heights by dy are independent, so a pair makes a row for each dx that meets, and a sum
    for each dy."""
    grid = shifts.select(F.col("dx").cast("double").alias("dx"), F.col("dy").cast("double").alias("dy")).collect()
    if not grid:
        return segments.select(*keys, *[F.lit(0.0).alias(c) for c in ("dx", "dy", "shared")], F.lit(0).cast("long").alias("n")).limit(0)
    xs, ys = sorted({r.dx for r in grid}), sorted({r.dy for r in grid})
    own = [F.col(c).alias(f"own_{c}") for c in spatial.BOX]
    wide = spatial.counted(refs).select("*", *own).withColumns({"x0": F.col("x0") - max(xs), "x1": F.col("x1") - min(xs), "y0": F.col("y0") - max(ys), "y1": F.col("y1") - min(ys)})
    pairs = spatial.box_pairs(spatial.counted(segments), wide)

    def shared(axis: str, d: Column) -> Column:
        low, high = F.greatest(F.col(f"l_{axis}0"), F.col(f"r_own_{axis}0") - d), F.least(F.col(f"l_{axis}1"), F.col(f"r_own_{axis}1") - d)
        return F.greatest(high - low, F.lit(0.0))

    across = F.filter(F.transform(F.array(*[F.lit(x) for x in xs]), lambda d: F.struct(d.alias("dx"), shared("x", d).alias("w"))), lambda s: s["w"] > 0)
    times = F.col("r_n") if keys else F.col("r_n") * F.col("l_n")
    by = [F.col(f"l_{c}").alias(c) for c in keys]
    rows = pairs.select(*by, F.col("l_n").alias("n"), times.alias("times"), F.explode(across).alias("s"), *[shared("y", F.lit(y)).alias(f"h{k}") for k, y in enumerate(ys)])
    sums = rows.groupBy(*keys, "s.dx").agg(F.max("n").alias("n"), *[F.sum(F.col("s.w") * F.col("times") * F.col(f"h{k}")).alias(f"a{k}") for k in range(len(ys))])
    return sums.select(*keys, "n", "dx", F.explode(F.array(*[F.struct(F.lit(y).alias("dy"), F.col(f"a{k}").alias("shared")) for k, y in enumerate(ys)])).alias("s")).select(*keys, "n", "dx", "s.*").filter("shared > 0")


def _numbered(moved: DataFrame, shifts: DataFrame) -> DataFrame:
    """The rows of `_shifted` with the shift's number."""
    return moved.join(F.broadcast(shifts.select("shift", F.col("dx").cast("double").alias("dx"), F.col("dy").cast("double").alias("dy"))), ["dx", "dy"])  # a grid of fixed size


def shifted_overlap(segments: DataFrame, refs: DataFrame, shifts: DataFrame) -> DataFrame:
    """Shared area of all segments with the references moved by each (dx, dy) of the grid `shifts`, of fixed size."""
    return _numbered(_shifted(segments, refs, shifts), shifts).select("shift", "shared")


def shifted_boxes(segments: DataFrame, refs: DataFrame, shifts: DataFrame, positive: float = 0.5, negative: float = 0.05) -> DataFrame:
    """(shift, scene_id, box, n, overlap, label) of the distinct boxes that some moved reference overlaps: 1, 0, or -1
    between the limits; n segments have the box. Boxes without a row at a shift overlap nothing there and are 0."""
    by = ("scene_id", *spatial.BOX)
    overlap = F.col("shared") / spatial.box_area()
    out = _numbered(_shifted(segments, refs, shifts, *by), shifts).select("shift", *by, "n", overlap.alias("overlap"))
    return out.withColumn("label", F.when(F.col("overlap") >= positive, 1).when(F.col("overlap") <= negative, 0).otherwise(-1))


def shifted_labels(segments: DataFrame, refs: DataFrame, shifts: DataFrame, positive: float = 0.5, negative: float = 0.05) -> DataFrame:
    """(shift, scene_id, id, overlap, label): the rows of `shifted_boxes` for each segment that has the box."""
    by = ["scene_id", *spatial.BOX]
    return segments.select("id", *by).join(shifted_boxes(segments, refs, shifts, positive, negative).drop("n"), by).select("shift", "scene_id", "id", "overlap", "label")


def shift_counts(segments: DataFrame, labels: DataFrame, shifts: DataFrame) -> DataFrame:
    """By shift: the labelled segments (n_train) and the positive ones, from `shifted_labels` or `shifted_boxes`."""
    n = segments.count()
    times = F.col("n") if "n" in labels.columns else F.lit(1).cast("long")
    many = lambda label: F.sum(F.when(F.col("label") == label, times))
    by = labels.groupBy("shift").agg(many(-1).alias("__open"), many(1).alias("__pos"))
    return shifts.select("shift").join(by, "shift", "left").select("shift", (F.lit(n) - F.coalesce("__open", F.lit(0))).alias("n_train"), F.coalesce("__pos", F.lit(0).cast("long")).alias("n_pos"))


def calibrated(features: DataFrame, refs: DataFrame, shifts: DataFrame, names: list[str], folds: int = 3, **params) -> DataFrame:
    """For each shift the counts of `shift_counts` and the quality of a forest trained on the labels that the shift gives
    (accuracy, precision, recall, f1; null where one label is missing). Forests are trained one after another."""
    labels = saved(shifted_labels(features, refs, shifts), "shift-labels")
    counts = {r.shift: r for r in shift_counts(features, labels, shifts).collect()}  # a grid of fixed size
    rows = []
    for shift, c in sorted(counts.items()):
        mine = labels.filter(F.col("shift") == shift).select("scene_id", "id", "label")
        labelled = features.drop("label").join(mine, ["scene_id", "id"], "left").withColumn("label", F.coalesce("label", F.lit(0)).cast("double")).filter("label >= 0")
        quality = cross_validated(labelled, names, "id", folds=folds, **params).first() if 0 < c.n_pos < c.n_train else (None,) * 4
        rows.append((shift, c.n_train, c.n_pos, *quality))
    return features.sparkSession.createDataFrame(rows, "shift long, n_train long, n_pos long, accuracy double, precision double, recall double, f1 double")


def best_shift(scores: DataFrame, score: str = "shared", n: int = 10) -> DataFrame:
    return scores.orderBy(F.desc(score), "shift").limit(n)


def infer(patches: DataFrame, predict: Callable[[pd.DataFrame], pd.Series]) -> DataFrame:
    """`patches` with p by a vectorised function over Arrow batches; patches to skip are filtered before."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(p=predict(pdf).astype("float64"))

    return patches.mapInPandas(run, T.StructType([*patches.schema.fields, T.StructField("p", T.DoubleType())]))


def detections(raw: DataFrame, transform: list, min_conf: float = 0.25) -> DataFrame:
    """Points from oriented boxes (corners in tile pixels): centre, place, class and percent; other classes go."""
    from geoloom.functions import pixels as px

    centre = geo.corners_centre(F.col("corners"))
    x, y = geo.affine(F.col("col_off") + F.col("__c.x"), F.col("row_off") + F.col("__c.y"), transform)
    out = raw.filter(F.col("conf") >= min_conf).withColumn("__c", centre).withColumn("cls", px.detected_class(F.col("class_no"))).filter("cls is not null")
    return out.withColumn("lon", x).withColumn("lat", y).withColumn("confidence", px.confidence_pct(F.col("conf"))).drop("__c")
