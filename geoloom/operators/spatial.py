"""Spatial joins by grid cells, overlap aggregation and point suppression.

A bounding-box join without an equality would be a nested loop. Here each box is dealt to the cells it touches and
joined on (scene, cell); a pair is kept only in the cell that holds its corner (max x0, max y0), so no distinct is
needed. Cells are of levels, powers of `LEVEL` in the data's own unit; a box lies on the level just above its size, so it
touches at most four cells there whatever the unit or the mixture of sizes.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions import geometry as geo
from geoloom.session import saved

#: A level's cells are this many times as wide as those of the level below.
LEVEL = 4
BOX = ("x0", "y0", "x1", "y1")


def _cell(x: Column, width: Column | float) -> Column:
    return F.floor(x / width).cast("long")


def _level() -> Column:
    """The lowest level at which the box is at most one cell wide and high; null for a point."""
    side = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")).cast("double")
    return F.when(side > 0, F.ceil(F.log(side) / math.log(LEVEL)).cast("int"))


def _dealt(df: DataFrame, levels: list[int]) -> DataFrame:
    """The box on its own level and on those above that hold boxes: a row for each cell that it touches."""
    own = F.coalesce(_level(), F.lit(levels[0]))
    up = F.explode(F.filter(F.array(*[F.lit(x) for x in levels]), lambda x: x >= F.col("__own")))
    width = F.pow(F.lit(float(LEVEL)), F.col("__level"))
    out = df.withColumn("__own", own).withColumn("__level", up).withColumn("__width", width)
    out = out.withColumn("__cx", F.explode(F.sequence(_cell(F.col("x0"), F.col("__width")), _cell(F.col("x1"), F.col("__width")))))
    return out.withColumn("__cy", F.explode(F.sequence(_cell(F.col("y0"), F.col("__width")), _cell(F.col("y1"), F.col("__width"))))).drop("__width")


def box_pairs(left: DataFrame, right: DataFrame, scene: str = "scene_id") -> DataFrame:
    """Pairs of boxes of one scene that intersect (touching counts); columns get the prefixes l_ and r_.

    Both sides have the scene column and x0, y0, x1, y1. A box lies on the level of its own size, and on all coarser
    levels that hold boxes of either side; each pair meets at the coarser of its two levels.
    """
    # one pass over the four numbers of all boxes; a few levels
    used = left.select(*BOX).unionByName(right.select(*BOX)).agg(F.collect_set(_level())).first()[0]
    levels = sorted(used) or [0]
    a, b = _dealt(left, levels), _dealt(right, levels)
    a = a.select(F.col(scene).alias("__s"), F.col("__level").alias("__v"), "__cx", "__cy", F.col("__own").alias("__lo"), *[F.col(c).alias(f"l_{c}") for c in left.columns])
    b = b.select(F.col(scene).alias("__s"), F.col("__level").alias("__v"), "__cx", "__cy", F.col("__own").alias("__ro"), *[F.col(c).alias(f"r_{c}") for c in right.columns])
    boxes = {s: {k: F.col(f"{s}_{k}") for k in BOX} for s in "lr"}
    pairs = a.join(b, ["__s", "__v", "__cx", "__cy"])
    width = F.pow(F.lit(float(LEVEL)), F.col("__v"))
    here = (F.col("__v") == F.greatest("__lo", "__ro")) & (F.col("__cx") == _cell(F.greatest("l_x0", "r_x0"), width)) & (F.col("__cy") == _cell(F.greatest("l_y0", "r_y0"), width))
    return pairs.filter(here & geo.boxes_touch(boxes["l"], boxes["r"])).drop("__s", "__v", "__cx", "__cy", "__lo", "__ro")


def counted(boxes: DataFrame, *more: str) -> DataFrame:
    """The distinct boxes (and further columns) of each scene, and n: how many rows have them. Copies make no pairs."""
    return boxes.groupBy("scene_id", *BOX, *more).agg(F.count(F.lit(1)).alias("n"))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Dealt by the keys to as many tasks as the session shuffles to: a few MB of geometry are long work for Python, and
    the adaptive plan would leave them to one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def pair_overlap() -> Column:
    return geo.box_overlap({k: F.col(f"l_{k}") for k in BOX}, {k: F.col(f"r_{k}") for k in BOX})


def box_area(prefix: str = "") -> Column:
    return (F.col(f"{prefix}x1") - F.col(f"{prefix}x0")) * (F.col(f"{prefix}y1") - F.col(f"{prefix}y0"))


def _shared(polygons: bool) -> tuple[Column, Column]:
    """Shared area of a pair and area of its left side: of the boxes, or of the geometries l_geom and r_geom."""
    if not polygons:
        return pair_overlap(), box_area("l_")
    from geoloom.operators import overlay

    return overlay.intersection_area(F.col("l_geom"), F.col("r_geom")), geo.area(F.col("l_geom"))


def match_objects(pred: DataFrame, gt: DataFrame, positive_area: bool = False, polygons: bool = False) -> DataFrame:
    """By scene: n_pred, n_gt, tp_pred, tp_gt, fp, fn. Any intersection matches, touching too unless `positive_area`.
    With `polygons` the boxes only choose pairs and the column geom decides."""
    pairs = box_pairs(pred, gt)
    if positive_area:
        pairs = pairs.filter(_shared(polygons)[0] > 0)
    elif polygons:
        from geoloom.operators import overlay

        pairs = pairs.filter(overlay.intersects(F.col("l_geom"), F.col("r_geom")))
    hits = pairs.groupBy(F.col("l_scene_id").alias("scene_id")).agg(F.count_distinct("l_id").alias("tp_pred"), F.count_distinct("r_id").alias("tp_gt"))
    counts = pred.groupBy("scene_id").agg(F.count(F.lit(1)).alias("n_pred")).join(gt.groupBy("scene_id").agg(F.count(F.lit(1)).alias("n_gt")), "scene_id", "full")
    out = counts.join(hits, "scene_id", "left").na.fill(0)
    return out.withColumn("fp", F.col("n_pred") - F.col("tp_pred")).withColumn("fn", F.col("n_gt") - F.col("tp_gt"))


def overlap_labels(segments: DataFrame, refs: DataFrame, positive: float = 0.5, negative: float = 0.05, polygons: bool = False) -> DataFrame:
    """Segments (id, scene_id, box) with overlap (sum of shared areas over the segment's; may exceed 1), label 1, 0
    or -1, and class and subtype of the largest overlap (ties: least id) where the label is 1."""
    # copies of a segment or of a reference are paired once; of equal references the least id leads
    by = ["scene_id", *BOX, *(["geom"] if polygons else [])]
    led = refs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
    pairs = box_pairs(segments.select(*by).distinct(), led)
    shared = (spread(pairs, *[f"l_{c}" for c in BOX], "r_id") if polygons else pairs).withColumn("shared", _shared(polygons)[0]).filter("shared > 0")
    # the largest share, then the least id: one pre-aggregated struct instead of a sort of each segment's pairs
    best = F.max(F.struct("shared", (-F.col("r_id")).alias("k"), *[F.col(f"r_{c}").alias(c) for c in BOX])).alias("m")
    sums = shared.groupBy(*[F.col(f"l_{c}").alias(c) for c in by]).agg(F.sum(F.col("shared") * F.col("r_n")).alias("total"), best)
    named = refs.select(F.col("scene_id").alias("__s"), F.col("id").alias("__id"), *[F.col(c).alias(f"__{c}") for c in BOX], F.col("class").alias("c"), F.col("subtype").alias("s"))
    same = (F.col("scene_id") == F.col("__s")) & (-F.col("m.k")).eqNullSafe(F.col("__id"))
    for c in BOX:
        same = same & (F.col(f"m.{c}") == F.col(f"__{c}"))
    sums = sums.join(named, same).groupBy(*by).agg(F.first("total").alias("total"), F.max(F.struct("c", "s")).alias("best"))
    out = segments.join(sums, by, "left").select(*[segments[c] for c in segments.columns], "total", "best").withColumn("__area", geo.area(F.col("geom")) if polygons else box_area())
    out = out.withColumn("overlap", F.when(F.col("__area") > 0, F.coalesce(F.col("total"), F.lit(0)) / F.col("__area")).otherwise(0.0))
    label = F.when(F.col("__area") <= 0, -1).when(F.col("overlap") >= positive, 1).when(F.col("overlap") <= negative, 0).otherwise(-1)
    tag = lambda c: F.when(F.col("label") == 1, F.when(~F.col(c).isin("None", "nan"), F.col(c)))
    return out.withColumn("label", label).withColumn("ref_class", tag("best.c")).withColumn("ref_subtype", tag("best.s")).drop("total", "best", "__area")


def usable_for_training(limit: float = 0.5) -> Column:
    """Unlabelled rows are used unless a mask covers them; -1 never is."""
    covered = (F.col("frac_vegetation") > limit) | (F.col("frac_shadow") > limit) | (F.col("frac_soil") > limit)
    return ~(F.coalesce(F.col("label") == -1, F.lit(False)) | F.coalesce(covered, F.lit(False)))


def last_piece(labels: DataFrame, key: str = "segment_id", ordinal: str = "piece") -> DataFrame:
    """Of a segment's pieces the one with the highest ordinal gives the label."""
    cols = [c for c in labels.columns if c != key]
    return labels.groupBy(key).agg(F.max(F.struct(ordinal, *[c for c in cols if c != ordinal])).alias("m")).select(key, "m.*")


def best_reference(pred: DataFrame, refs: DataFrame, least_share: float = 0.3, polygons: bool = False) -> DataFrame:
    """Predictions with the reference of the largest overlap (ties: least id); none if it covers under `least_share`."""
    overlap, area = _shared(polygons)
    shared = box_pairs(pred, refs).withColumn("shared", overlap).withColumn("l_area", area).filter("shared > 0")
    rank = Window.partitionBy("l_scene_id", "l_id").orderBy(F.desc("shared"), "r_id")
    best = shared.withColumn("__n", F.row_number().over(rank)).filter("__n = 1")
    keep = best.filter(F.col("shared") / F.col("l_area") >= least_share)
    return pred.join(keep.select(F.col("l_scene_id").alias("scene_id"), F.col("l_id").alias("id"), F.col("r_id").alias("ref_id"), F.col("r_class").alias("ref_class"), F.col("r_subtype").alias("ref_subtype"), F.col("r_num_floors").alias("ref_floors"), "shared"), ["scene_id", "id"], "left")


def clip_boxes(rows: DataFrame, scenes: DataFrame) -> DataFrame:
    """Rows cut to every scene box that they intersect with positive area; a row may stand in several scenes."""
    one = F.lit(0)  # scenes are found by place alone
    pairs = box_pairs(rows.drop("scene_id").withColumn("all", one), scenes.select("scene_id", *BOX).withColumn("all", one), "all").filter(pair_overlap() > 0)
    new = {c: (F.greatest if c in ("x0", "y0") else F.least)(f"l_{c}", f"r_{c}") for c in BOX}
    return pairs.select(F.col("r_scene_id").alias("scene_id"), *[F.col(f"l_{c}").alias(c) for c in rows.columns if c not in (*BOX, "scene_id")], *[v.alias(c) for c, v in new.items()])


def suppress_points(points: DataFrame, radius: float, tile: int = 32, save: Callable[[DataFrame, str], DataFrame] = saved) -> DataFrame:
    """Greedy suppression by scene: by falling conf (ties: least id) a point stays unless a kept one is nearer than
    `radius`.

    A scene is dealt to square tiles of `tile` radii with the points up to a radius around them. Within a tile points are
    settled in order; one whose fate hangs on an open point beyond the edge stays open for the next round, in which its
    neighbour's fate is known. The result is that of one pass over the scene, and no scene is one task's."""
    side = float(radius * tile)
    near = lambda c: F.explode(F.sequence(F.floor((F.col(c) - radius) / side), F.floor((F.col(c) + radius) / side)))

    def settle(table: pa.Table) -> pa.Table:
        x, y, conf, ids, state, own = (table.column(c).to_numpy(zero_copy_only=False) for c in ("x", "y", "conf", "id", "state", "own"))
        state = state.copy()
        kept: dict[tuple[int, int], list[int]] = {}
        open_: dict[tuple[int, int], list[int]] = {}
        cx, cy = np.floor(x / radius).astype(int).tolist(), np.floor(y / radius).astype(int).tolist()

        def meets(i: int, cells: dict[tuple[int, int], list[int]]) -> bool:
            return any((x[i] - x[j]) ** 2 + (y[i] - y[j]) ** 2 < radius * radius for a in (cx[i] - 1, cx[i], cx[i] + 1) for b in (cy[i] - 1, cy[i], cy[i] + 1) for j in cells.get((a, b), ()))

        for i in np.lexsort((ids, -conf)).tolist():
            if state[i] == 0 and own[i]:
                state[i] = 2 if meets(i, kept) else 0 if meets(i, open_) else 1
            if state[i] < 2:
                (kept if state[i] else open_).setdefault((cx[i], cy[i]), []).append(i)
        out = table.select(["scene_id", "id", "x", "y", "conf"]).append_column("state", pa.array(state, pa.int32()))
        return out.filter(pa.array(own, pa.bool_()))

    kinds = dict(points.dtypes)
    schema = ", ".join(f"{c} {'double' if c in ('x', 'y') else kinds[c]}" for c in ("scene_id", "id", "x", "y", "conf")) + ", state int"
    rows = points.select("scene_id", "id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "conf", F.lit(0).alias("state"))
    while True:  # the first open point of all is settled in each round
        dealt = rows.withColumn("__i", near("x")).withColumn("__j", near("y")).withColumn("own", (F.col("__i") == F.floor(F.col("x") / side)) & (F.col("__j") == F.floor(F.col("y") / side)))
        rows = save(dealt.groupBy("scene_id", "__i", "__j").applyInArrow(settle, schema), "suppression")
        if rows.filter("state = 0").limit(1).count() == 0:
            break
    return points.join(rows.filter("state = 1").select("scene_id", "id"), ["scene_id", "id"], "left_semi")


def union_areas(boxes: DataFrame, keys: tuple[str, ...] = ("scene_id",), layer: str = "layer", side: float = 64.0) -> DataFrame:
    """By key: areas of the union of layer `a`, of layer `b`, and of their intersection, by square cells, so that neither
    a scene nor a stripe of it is one task's."""
    across = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / side), F.floor(F.col(hi) / side)))
    dealt = boxes.select(*keys, layer, *BOX, across("x0", "x1").alias("__i")).select("*", across("y0", "y1").alias("__j"))
    for lo, hi, at in (("x0", "x1", "__i"), ("y0", "y1", "__j")):
        dealt = dealt.withColumn(lo, F.greatest(F.col(lo), F.col(at) * side)).withColumn(hi, F.least(F.col(hi), (F.col(at) + 1) * side)).filter(F.col(hi) > F.col(lo))

    def run(table: pa.Table) -> pa.Table:
        edges = np.stack([table.column(c).to_numpy(zero_copy_only=False).astype(float) for c in BOX], 1)
        is_a = np.array(table.column(layer).to_pylist()) == "a"
        areas = grid_areas(edges[is_a], edges[~is_a])
        return pa.table({k: table.column(k).slice(0, 1) for k in keys} | {n: pa.array([v], pa.float64()) for n, v in zip(("area_a", "area_b", "area_ab"), areas)})

    schema = ", ".join(f"{k} {dict(boxes.dtypes)[k]}" for k in keys)
    parts = dealt.groupBy(*keys, "__i", "__j").applyInArrow(run, f"{schema}, area_a double, area_b double, area_ab double")
    return parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("area_a", "area_b", "area_ab")])


def grid_areas(a: np.ndarray, b: np.ndarray) -> tuple[float, float, float]:
    """Union areas of two sets of boxes (rows x0, y0, x1, y1) and the area of their intersection, on the grid of all
    their edges."""
    every = np.concatenate((a, b))
    xs, ys = np.unique(every[:, [0, 2]]), np.unique(every[:, [1, 3]])
    cell = np.diff(xs)[:, None] * np.diff(ys)[None, :]

    def covered(rows: np.ndarray) -> np.ndarray:
        turns = np.zeros((len(xs), len(ys)), np.int64)  # corners of boxes; their running sums count the boxes over a cell
        x0, y0, x1, y1 = (np.searchsorted(*p) for p in ((xs, rows[:, 0]), (ys, rows[:, 1]), (xs, rows[:, 2]), (ys, rows[:, 3])))
        for i, j, d in ((x0, y0, 1), (x1, y0, -1), (x0, y1, -1), (x1, y1, 1)):
            np.add.at(turns, (i, j), d)
        return turns.cumsum(0).cumsum(1)[:-1, :-1] > 0

    in_a, in_b = covered(a), covered(b)
    return float(cell[in_a].sum()), float(cell[in_b].sum()), float(cell[in_a & in_b].sum())
