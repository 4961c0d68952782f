"""Registered queries over the driver tables, with their oracles for DuckDB.

The queries apply the operators to the geo views of `plans.views`. Doubles whose last digit may differ between
engines are returned as scaled integers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoloom.functions import geometry as geo
from geoloom.functions import kernels
from geoloom.functions import pixels as px
from geoloom.operators import metrics, ml, overlay, rules, schema, segments, spatial, tiles
from geoloom.plans import segment_stage
from geoloom.plans.views import tile_rows, view, with_views
from geoloom.session import saved, work_path
from geoloom.sources import geojson, geopackage, raster, store, tables

_ALL: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    _ALL[f.__name__] = f
    return f


def _oracle(name: str, sql: str, *views: str) -> None:
    _SQL[name] = with_views(*views) + (", " if views and not sql.lstrip().lower().startswith("select") else " ") + sql if views else sql


def _scaled(c: Column, by: float = 1e6) -> Column:
    return F.floor(c * by + 0.5).cast("long")


def _rgb() -> list[Column]:
    return [F.col(c) for c in ("r", "g", "b")]


@_query
def q01_object_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = spatial.match_objects(view(spark, sf_dir, "v_pred"), view(spark, sf_dir, "v_gt"))
    out = metrics.with_aggregate(counts)
    return out.select("scene_id", "n_pred", "n_gt", "tp_pred", "tp_gt", "fp", "fn", *[_scaled(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])


_oracle("q01_object_match", """
 p as (select scene_id, count(*) n_pred from v_pred group by 1), g as (select scene_id, count(*) n_gt from v_gt group by 1),
 h as (select a.scene_id, count(distinct a.id) tp_pred, count(distinct b.id) tp_gt from v_pred a join v_gt b
       on a.scene_id = b.scene_id and a.x0 <= b.x1 and b.x0 <= a.x1 and a.y0 <= b.y1 and b.y0 <= a.y1 group by 1),
 c as (select scene_id, coalesce(n_pred,0) n_pred, coalesce(n_gt,0) n_gt, coalesce(tp_pred,0) tp_pred, coalesce(tp_gt,0) tp_gt
       from p full join g using (scene_id) left join h using (scene_id)),
 a as (select cast(scene_id as varchar) scene_id, n_pred, n_gt, tp_pred, tp_gt from c
       union all select 'AGGREGATE', sum(n_pred), sum(n_gt), sum(tp_pred), sum(tp_gt) from c),
 q as (select *, case when n_pred > 0 then tp_pred / (n_pred + 1e-9) else 0e0 end pr, case when n_gt > 0 then tp_gt / (n_gt + 1e-9) else 0e0 end rc from a)
select scene_id, cast(n_pred as bigint) n_pred, cast(n_gt as bigint) n_gt, cast(tp_pred as bigint) tp_pred, cast(tp_gt as bigint) tp_gt,
       cast(n_pred - tp_pred as bigint) fp, cast(n_gt - tp_gt as bigint) fn, cast(floor(pr * 1e6 + 0.5e0) as bigint) "precision",
       cast(floor(rc * 1e6 + 0.5e0) as bigint) recall, cast(floor(2 * pr * rc / (pr + rc + 1e-9) * 1e6 + 0.5e0) as bigint) f1 from q""", "v_pred", "v_gt")  # fmt: skip

_SHARED = """s as (select a.scene_id, a.id, b.id rid, b.class, b.subtype, b.num_floors, (a.x1-a.x0)*(a.y1-a.y0) area,
   (least(a.x1,b.x1)-greatest(a.x0,b.x0)) * (least(a.y1,b.y1)-greatest(a.y0,b.y0)) shared
   from v_pred a join v_gt b on a.scene_id = b.scene_id and a.x0 < b.x1 and b.x0 < a.x1 and a.y0 < b.y1 and b.y0 < a.y1)"""


@_query
def q02_overlap_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spatial.overlap_labels(view(spark, sf_dir, "v_pred"), view(spark, sf_dir, "v_gt"))
    return out.select("scene_id", "id", _scaled(F.col("overlap")).alias("overlap"), F.col("label").cast("int").alias("label"), "ref_class", "ref_subtype")


_oracle("q02_overlap_label", _SHARED + """,
 t as (select scene_id, id, sum(shared) total, max(area) area, arg_max(struct_pack(c := class, s := subtype), shared * 1000000000 - rid) best from s group by 1, 2),
 o as (select p.scene_id, p.id, coalesce(t.total, 0) / cast((p.x1-p.x0)*(p.y1-p.y0) as double) f, t.best from v_pred p left join t using (scene_id, id)),
 l as (select *, case when f >= 0.5e0 then 1 when f <= 0.05e0 then 0 else -1 end label from o)
select scene_id, id, cast(floor(f * 1e6 + 0.5e0) as bigint) overlap, cast(label as int) label,
       case when label = 1 and best.c not in ('None', 'nan') then best.c end ref_class, case when label = 1 and best.s not in ('None', 'nan') then best.s end ref_subtype from l""", "v_pred", "v_gt")  # fmt: skip


@_query
def q03_best_overlap_subclass(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spatial.best_reference(view(spark, sf_dir, "v_pred"), view(spark, sf_dir, "v_gt"))
    cls = rules.building_class(F.col("ref_class"), F.col("ref_subtype"), F.col("ref_floors"), spatial.box_area())
    return out.select("scene_id", "id", "ref_id", cls.alias("class"), F.col("ref_id").isNotNull().cast("int").alias("matched"))


def _case_map(expr: str, values: dict[str, str]) -> str:
    return f"case {expr} " + " ".join(f"when '{k}' then '{v}'" for k, v in values.items()) + " end"


_AREA_CLASS = "case when area <= 250 then 'house' else 'apartment_block' end"
_oracle("q03_best_overlap_subclass", _SHARED + f""",
 b as (select * from s qualify row_number() over (partition by scene_id, id order by shared desc, rid) = 1),
 m as (select p.scene_id, p.id, b.rid, b.class, b.subtype, case when not isnan(b.num_floors) then b.num_floors end nf, (p.x1-p.x0)*(p.y1-p.y0) area
       from v_pred p left join b on p.scene_id = b.scene_id and p.id = b.id and b.shared / cast(b.area as double) >= 0.3e0)
select scene_id, id, rid ref_id, coalesce({_case_map("trim(lower(class))", rules.CLASSES)},
   case when trim(lower(subtype)) = 'residential' then case when nf >= 3 then 'apartment_block' when nf >= 1 then 'house' else {_AREA_CLASS} end end,
   {_case_map("trim(lower(subtype))", rules.SUBTYPES)}, {_AREA_CLASS}) class, cast(rid is not null as int) matched from m""", "v_pred", "v_gt")  # fmt: skip


def _cross_boxes(spark: SparkSession) -> DataFrame:
    """Four scene boxes that overlap, so that rows may be cut to several."""
    k = F.col("id")
    return spark.range(4).select(k.alias("scene_id"), ((k % 2) * 450).alias("x0"), (F.floor(k / 2) * 450).alias("y0"), ((k % 2) * 450 + 550).alias("x1"), (F.floor(k / 2) * 450 + 550).alias("y1"))


@_query
def q04_clip_to_aoi(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spatial.clip_boxes(view(spark, sf_dir, "v_gt").select("scene_id", "id", *spatial.BOX), _cross_boxes(spark))
    return out.select("scene_id", "id", *[F.col(c).cast("long").alias(c) for c in spatial.BOX])


_oracle("q04_clip_to_aoi", """
 b as (select i scene_id, (i % 2) * 450 x0, (i // 2) * 450 y0, (i % 2) * 450 + 550 x1, (i // 2) * 450 + 550 y1 from range(4) t(i))
select b.scene_id, g.id, cast(greatest(g.x0, b.x0) as bigint) x0, cast(greatest(g.y0, b.y0) as bigint) y0, cast(least(g.x1, b.x1) as bigint) x1, cast(least(g.y1, b.y1) as bigint) y1
from v_gt g join b on g.x0 < b.x1 and b.x0 < g.x1 and g.y0 < b.y1 and b.y0 < g.y1""", "v_gt")  # fmt: skip


@_query
def q05_tile_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tiles.tiles(view(spark, sf_dir, "v_scene"))
    return out.select("scene_id", *[F.col(c).cast("long").alias(c) for c in ("tile_idx", "col_off", "row_off", "width", "height")], tiles.n_tiles(F.col("width_px"), F.col("height_px")).cast("long").alias("n_tiles"))


_TILES_SQL = """
select scene_id, cast((r // 896) * ceil(width_px / 896.0) + c // 896 as bigint) tile_idx, c col_off, r row_off, least(1024, width_px - c) width, least(1024, height_px - r) height,
       cast(ceil(width_px / 896.0) * ceil(height_px / 896.0) as bigint) n_tiles
from v_scene, range(0, 10000, 896) x(c), range(0, 10000, 896) y(r) where c < width_px and r < height_px"""
_oracle("q05_tile_grid", _TILES_SQL, "v_scene")


@_query
def q06_patch_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.patches(view(spark, sf_dir, "v_scene")).select("scene_id", F.col("col").cast("long").alias("col"), F.col("row").cast("long").alias("row"))


_oracle("q06_patch_grid", """
 c as (select scene_id, v col from v_scene, range(0, 10000, 192) t(v) where v <= width_px - 256 union select scene_id, width_px - 256 from v_scene),
 r as (select scene_id, v "row" from v_scene, range(0, 10000, 192) t(v) where v <= height_px - 256 union select scene_id, height_px - 256 from v_scene)
select c.scene_id, cast(c.col as bigint) col, cast(r."row" as bigint) "row" from c join r using (scene_id)""", "v_scene")  # fmt: skip

_INDEX = {"exg": px.excess_green, "v": px.color_invariance, "s": px.shadow_invariance, "vigreen": px.vi_green, "ngbdi": px.ngbdi, "dsbi": px.dsbi, "cive": px.cive, "vig": px.vig}
_INDEX_SQL = {
    "exg": "2*g-r-b", "v": "4/pi()*atan((g-b)/(g+b+1e-6))", "s": "4/pi()*atan(((r+g+b)/3-sqrt(r*r+g*g+b*b))/((r+g+b)/3+sqrt(r*r+g*g+b*b)+1e-6))",
    "vigreen": "g/(pow(g+1e-6,0.667e0)*pow(b+1e-6,0.333e0))", "ngbdi": "(g-b)/(g+b+1e-6)", "dsbi": "0.5e0*(b-r)+0.5e0*(b-g)",
    "cive": "0.441e0*(r/255/((r+g+b)/255+1e-9))-0.811e0*(g/255/((r+g+b)/255+1e-9))+0.385e0*(b/255/((r+g+b)/255+1e-9))+18.78745e0", "vig": "(g-r)/(g+r+1e-6)",
}


@_query
def q07_rgb_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of rounded index values, which do not depend on the last digit of a double."""
    p = view(spark, sf_dir, "v_pixel")
    return p.groupBy("scene_id").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.floor(f(*_rgb()) * 1e4 + 0.5).cast("long")).alias(n) for n, f in _INDEX.items()])


_oracle("q07_rgb_indices", "select scene_id, count(*) n, " + ", ".join(f"cast(sum(cast(floor(({e}) * 1e4 + 0.5e0) as bigint)) as bigint) {n}" for n, e in _INDEX_SQL.items()) + " from v_pixel group by 1", "v_pixel")

_VEG = f"(cast({_INDEX_SQL['exg']} > 8 as int) + cast({_INDEX_SQL['v']} > 0.05e0 as int) + cast({_INDEX_SQL['cive']} < 18.78e0 as int) + cast({_INDEX_SQL['vig']} > 0 as int) >= 2 and valid)"
_DARK = f"((r+g+b)/3 < 60 and {_INDEX_SQL['s']} > 0 and valid)"
_SOIL = "(r >= g-5 and r > b+8 and g > b and 2*g-r-b < 5 and (r+g+b)/3 > 70 and (r+g+b)/3 < 200 and valid)"


def _cleaned_sql(source: str, radius: int, masks: tuple[str, ...], out: str) -> str:
    """CTEs that open and then close masks (0 or 1) of tiles by a disk; outside counts as set for erosion and unset for
    dilation."""
    steps, last = [], source
    for k, f in enumerate(("min", "max", "max", "min")):
        name = out if k == 3 else f"{out}{k}"
        steps.append(f"{name} as materialized (select a.tile_id, a.pos, a.prow, a.pcol, {', '.join(f'{f}(b.{m}) {m}' for m in masks)} from {last} a join {last} b on a.tile_id = b.tile_id and (a.prow-b.prow)*(a.prow-b.prow) + (a.pcol-b.pcol)*(a.pcol-b.pcol) <= {radius * radius} group by 1, 2, 3, 4)")
        last = name
    return ", ".join(steps)


def _masked(spark: SparkSession, sf_dir: str, radius: int = 3) -> DataFrame:
    return segments.masked_pixels(_spread(tile_rows(spark, sf_dir)), ["tile_id", "scene_id"], radius)


def _masked_sql(radius: int) -> str:
    """v_mask: the pixels with their cleaned masks as 0 or 1."""
    raw = f"mk as materialized (select tile_id, pos, prow, pcol, cast({_VEG} as int) veg, cast({_DARK} as int) dark, cast({_SOIL} as int) bare from v_pixel)"
    return raw + ", " + _cleaned_sql("mk", radius, ("veg", "dark", "bare"), "mc") + ", v_mask as (select v_pixel.*, veg = 1 veg, dark = 1 dark, bare = 1 bare from v_pixel join mc using (tile_id, pos))"


@_query
def q08_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks as the thresholds give them, and cleaned by a small and by the default disk."""
    parts = []
    for radius in (0, 1, 3):
        p = _masked(spark, sf_dir, radius)
        parts.append(p.groupBy("scene_id").agg(F.lit(radius).alias("radius"), F.count_if("veg").alias("veg"), F.count_if("dark").alias("dark"), F.count_if("bare").alias("bare"), *[F.count_if(F.col("cover") == c).alias(f"c_{c}") for c in ("vegetation", "shadow", "soil")]))
    return schema.concat(*parts)


_oracle("q08_masks", f"mk as materialized (select tile_id, pos, prow, pcol, cast({_VEG} as int) veg, cast({_DARK} as int) dark, cast({_SOIL} as int) bare from v_pixel), " + _cleaned_sql("mk", 1, ("veg", "dark", "bare"), "m1") + ", " + _cleaned_sql("mk", 3, ("veg", "dark", "bare"), "m3") + """,
 m as (select 0 radius, * from mk union all select 1, * from m1 union all select 3, * from m3)
select scene_id, cast(radius as int) radius, cast(sum(veg) as bigint) veg, cast(sum(dark) as bigint) dark, cast(sum(bare) as bigint) bare, cast(sum(veg) as bigint) c_vegetation,
       count(*) filter (dark = 1 and veg = 0) c_shadow, count(*) filter (bare = 1 and veg = 0 and dark = 0) c_soil from m join (select distinct tile_id, scene_id from v_pixel) using (tile_id) group by 1, 2""", "v_pixel")  # fmt: skip


@_query
def q09_segment_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = segments.color_features(_masked(spark, sf_dir), ["tile_id"])
    names = ("r_mean", "g_mean", "b_mean", "r_std", "intensity_mean", "intensity_std", "exg_mean", "v_idx_mean", "cive_mean", "vig_mean", "frac_vegetation", "frac_shadow", "frac_soil")
    # a mean's last digit depends on the order of its sum: halves are nudged up
    return f.select("tile_id", *[F.floor(F.col(c) * 1e4 + 0.5000001).cast("long").alias(c) for c in names])


def _seg(radius: int) -> str:
    return _masked_sql(radius) + f""", f as (select tile_id, scene_id, avg(r) r_mean, avg(g) g_mean, avg(b) b_mean, stddev_pop(r) r_std, avg((r+g+b)/3) intensity_mean, stddev_pop((r+g+b)/3) intensity_std,
   avg({_INDEX_SQL['exg']}) exg_mean, avg({_INDEX_SQL['v']}) v_idx_mean, avg({_INDEX_SQL['cive']}) cive_mean, avg({_INDEX_SQL['vig']}) vig_mean,
   avg(cast(veg as int)) frac_vegetation, avg(cast(dark and not veg as int)) frac_shadow, avg(cast(bare and not veg and not dark as int)) frac_soil
   from v_mask group by 1, 2)"""


_oracle("q09_segment_colour", _seg(3) + " select tile_id, " + ", ".join(f"cast(floor({c} * 1e4 + 0.5000001e0) as bigint) {c}" for c in ("r_mean", "g_mean", "b_mean", "r_std", "intensity_mean", "intensity_std", "exg_mean", "v_idx_mean", "cive_mean", "vig_mean", "frac_vegetation", "frac_shadow", "frac_soil")) + " from f", "v_pixel")


@_query
def q10_tile_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = tiles.good_tiles(view(spark, sf_dir, "v_pixel"), ["tile_id"], min_valid=63, min_mean=110.0)
    return good.select("tile_id", "n_valid", _scaled(F.col("mean_rgb")).alias("mean_rgb"), (F.col("valid_share") >= 1.0).alias("whole"))


_oracle("q10_tile_quality", """select tile_id, count(*) filter (valid) n_valid, cast(floor(avg(r+g+b)/3 * 1e6 + 0.5e0) as bigint) mean_rgb, avg(cast(valid as int)) >= 1 whole
from v_pixel group by 1 having count(*) filter (valid) >= 63 and avg(r+g+b)/3 >= 110""", "v_pixel")  # fmt: skip


@_query
def q11_landcover_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Land cover of segments, by masks as they are and cleaned with a small and the default disk."""
    parts = [rules.land_cover(segments.color_features(_masked(spark, sf_dir, radius), ["tile_id"])).select("tile_id", F.lit(radius).alias("radius"), "class", "confidence") for radius in (0, 1, 3)]
    return schema.concat(*parts)


def _cover_sql(radius: int) -> str:
    """A query of its own: CTEs cannot be named twice in one."""
    return f"""select * from (with {_seg(radius)} select tile_id, cast({radius} as int) radius, 'vegetation' class, cast(round_even(frac_vegetation * 100, 0) as int) confidence from f where frac_vegetation >= 0.5e0
 union all select tile_id, {radius}, 'bare_soil', cast(round_even(frac_soil * 100, 0) as int) from f where frac_soil >= 0.5e0)"""


_oracle("q11_landcover_select", " union all ".join(map(_cover_sql, (0, 1, 3))), "v_pixel")


@_query
def q12_prob_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = tiles.mosaic(view(spark, sf_dir, "v_prob"), ["scene_id", "arow", "acol"])
    return m.select("scene_id", "arow", "acol", "n", _scaled(F.col("p")).alias("p"), (_scaled(F.col("p")) >= 500_000).alias("positive"))


_oracle("q12_prob_average", "select scene_id, arow, acol, count(*) n, cast(floor(avg(p) * 1e6 + 0.5e0) as bigint) p, cast(floor(avg(p) * 1e6 + 0.5e0) as bigint) >= 500000 positive from v_prob group by 1, 2, 3", "v_prob")


@_query
def q13_pixel_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = metrics.pixel_quality(view(spark, sf_dir, "v_bin"), [])
    return q.select("tp", "fp", "fn", _scaled(F.col("f1")).alias("f1"), _scaled(F.col("iou")).alias("iou"))


_oracle("q13_pixel_metrics", """
 c as (select cast(sum(pred*truth) as bigint) tp, cast(sum(pred*(1-truth)) as bigint) fp, cast(sum((1-pred)*truth) as bigint) fn from v_bin)
select *, cast(floor(2*tp/(2*tp+fp+fn+1e-6) * 1e6 + 0.5e0) as bigint) f1, cast(floor(tp/(tp+fp+fn+1e-6) * 1e6 + 0.5e0) as bigint) iou from c""", "v_bin")  # fmt: skip


@_query
def q14_nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.suppress_points(view(spark, sf_dir, "v_det"), 8.0).select("scene_id", "id", "conf")


_oracle("q14_nms", """
 o as (select *, row_number() over (partition by scene_id order by conf desc, id) k from v_det),
 w(scene_id, k, kept) as (select scene_id, cast(0 as bigint), cast([] as struct(id bigint, conf bigint, x double, y double)[]) from o group by 1
   union all select w.scene_id, o.k, case when len(list_filter(w.kept, lambda q: (q.x-o.x)*(q.x-o.x) + (q.y-o.y)*(q.y-o.y) < 64)) = 0
     then list_append(w.kept, struct_pack(id := o.id, conf := o.conf, x := o.x, y := o.y)) else w.kept end
   from w join o on o.scene_id = w.scene_id and o.k = w.k + 1)
select scene_id, q.id id, q.conf conf from (select scene_id, unnest(kept) q from w qualify row_number() over (partition by scene_id order by k desc) = 1)""", "v_det")  # fmt: skip


def _scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = view(spark, sf_dir, "v_scene")
    km2 = geo.scene_area_km2(F.col("width_px") * F.col("res_deg"), F.col("height_px") * F.col("res_deg"), F.col("lat1"))
    return s.withColumn("aoi_area_km2", F.floor(km2 * 1e6) / 1e6)


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    pred = view(spark, sf_dir, "v_pred").withColumn("area_m2", spatial.box_area().cast("double")).withColumn("class", F.when(F.col("id") % 7 == 0, "garage").when(F.col("area_m2") <= 250, "house").otherwise("apartment_block"))
    cover = view(spark, sf_dir, "v_gt").withColumn("area_m2", spatial.box_area().cast("double")).withColumn("class", F.when(F.col("id") % 3 == 0, "vegetation").when(F.col("id") % 3 == 1, "bare_soil").otherwise("water"))
    return metrics.scene_metrics(_scenes(spark, sf_dir), pred, view(spark, sf_dir, "v_det"), cover)


_METRIC = ("buildings_density_per_km2", "cars_density_per_km2", "buildings_share_of_aoi_pct", "vegetation_share_pct", "bare_soil_share_pct")
_METRICS_SQL = """
 sc as (select *, floor(width_px*res_deg*111320e0*cos(radians(lat1))*height_px*res_deg*110540e0/1e6*1e6)/1e6 aoi_area_km2 from v_scene),
 pb as (select scene_id, cast((x1-x0)*(y1-y0) as double) a, case when id % 7 = 0 then 'garage' when (x1-x0)*(y1-y0) <= 250 then 'house' else 'apartment_block' end class from v_pred),
 bb as (select scene_id, count(*) filter (class = 'house') n_house, count(*) filter (class = 'apartment_block') n_apartment_block, sum(a) barea from pb group by 1),
 cc as (select scene_id, count(*) n_cars from v_det group by 1),
 vv as (select scene_id, sum(case when id % 3 = 0 then (x1-x0)*(y1-y0) else 0 end) varea, sum(case when id % 3 = 1 then (x1-x0)*(y1-y0) else 0 end) sarea from v_gt group by 1),
 mm as (select sc.scene_id, city, split, aoi_area_km2, coalesce(n_house,0) n_house, coalesce(n_apartment_block,0) n_apartment_block, coalesce(n_house,0)+coalesce(n_apartment_block,0) n_buildings_total,
   cast(coalesce(barea,0) as double) buildings_total_area_m2, coalesce(n_cars,0) n_cars, cast(coalesce(varea,0) as double) vegetation_area_m2, cast(coalesce(sarea,0) as double) bare_soil_area_m2
   from sc left join bb using (scene_id) left join cc using (scene_id) left join vv using (scene_id)),
 m as (select *, case when aoi_area_km2 > 0 then n_buildings_total/aoi_area_km2 else 0 end buildings_density_per_km2, case when aoi_area_km2 > 0 then n_cars/aoi_area_km2 else 0 end cars_density_per_km2,
   100*buildings_total_area_m2/(aoi_area_km2*1e6+1e-9) buildings_share_of_aoi_pct, 100*vegetation_area_m2/(aoi_area_km2*1e6+1e-9) vegetation_share_pct, 100*bare_soil_area_m2/(aoi_area_km2*1e6+1e-9) bare_soil_share_pct from mm)"""


def _micro(c: str) -> Column:
    return _scaled(F.col(c), 1e3).alias(c)


def _micro_sql(c: str, name: str = "") -> str:
    return f"cast(floor(({c}) * 1e3 + 0.5e0) as bigint) {name or c}"


@_query
def q15_scene_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _metrics(spark, sf_dir)
    return m.select("scene_id", "city", "split", "n_house", "n_apartment_block", "n_buildings_total", "n_cars", *[F.col(c).cast("long").alias(c) for c in ("buildings_total_area_m2", "vegetation_area_m2", "bare_soil_area_m2")], *[_micro(c) for c in _METRIC])


_oracle("q15_scene_metrics", _METRICS_SQL + " select scene_id, city, split, n_house, n_apartment_block, n_buildings_total, n_cars, cast(buildings_total_area_m2 as bigint) buildings_total_area_m2, cast(vegetation_area_m2 as bigint) vegetation_area_m2, cast(bare_soil_area_m2 as bigint) bare_soil_area_m2, " + ", ".join(map(_micro_sql, _METRIC)) + " from m", "v_scene", "v_pred", "v_det", "v_gt")


@_query
def q16_city_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = metrics.city_summary(_metrics(spark, sf_dir))
    return c.select("city", "scenes", "buildings", "houses", "blocks", "cars", *[_micro(x) for x in ("area_km2", "cars_per_km2", "buildings_pct", "vegetation_pct", "soil_pct", "concrete")])


_oracle("q16_city_summary", _METRICS_SQL + " select city, count(*) scenes, cast(sum(n_buildings_total) as bigint) buildings, cast(sum(n_house) as bigint) houses, cast(sum(n_apartment_block) as bigint) blocks, cast(sum(n_cars) as bigint) cars, " + ", ".join([_micro_sql("sum(aoi_area_km2)", "area_km2"), _micro_sql("avg(cars_density_per_km2)", "cars_per_km2"), _micro_sql("avg(buildings_share_of_aoi_pct)", "buildings_pct"), _micro_sql("avg(vegetation_share_pct)", "vegetation_pct"), _micro_sql("avg(bare_soil_share_pct)", "soil_pct"), _micro_sql("avg(buildings_share_of_aoi_pct - vegetation_share_pct)", "concrete")]) + " from m group by 1", "v_scene", "v_pred", "v_det", "v_gt")


@_query
def q17_class_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = spatial.best_reference(view(spark, sf_dir, "v_pred"), view(spark, sf_dir, "v_gt"))
    named = best.withColumn("class", rules.building_class(F.col("ref_class"), F.col("ref_subtype"), F.col("ref_floors"), spatial.box_area()))
    return metrics.class_distribution(named)


_SQL["q17_class_distribution"] = "select class, count(*) n from (" + _SQL["q03_best_overlap_subclass"] + ") group by 1"


@_query
def q18_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.top_scenes(_metrics(spark, sf_dir)).select("category", "place", "scene_id", "city", _micro("value"))


_oracle("q18_top3", _METRICS_SQL + """,
 w as (select scene_id, city, 'traffic' category, cars_density_per_km2 v, -cars_density_per_km2 o from m union all select scene_id, city, 'density', n_buildings_total/aoi_area_km2, -n_buildings_total/aoi_area_km2 from m
  union all select scene_id, city, 'green', vegetation_share_pct, -vegetation_share_pct from m union all select scene_id, city, 'concrete', buildings_share_of_aoi_pct-vegetation_share_pct, vegetation_share_pct-buildings_share_of_aoi_pct from m
  union all select scene_id, city, 'green_belt', buildings_share_of_aoi_pct-vegetation_share_pct, buildings_share_of_aoi_pct-vegetation_share_pct from m),
 r as (select *, cast(row_number() over (partition by category order by o, scene_id) as int) place from w)
select category, place, scene_id, city, cast(floor(v * 1e3 + 0.5e0) as bigint) "value" from r where place <= 3""", "v_scene", "v_pred", "v_det", "v_gt")  # fmt: skip


@_query
def q19_shift_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = view(spark, sf_dir, "v_gt").select("scene_id", *spatial.BOX)
    scores = ml.shifted_overlap(view(spark, sf_dir, "v_pred").select("scene_id", *spatial.BOX), refs, _shifts(spark))
    return ml.best_shift(scores).select("shift", F.col("shared").cast("long").alias("shared"))


_oracle("q19_shift_grid", """
 g as (select i * 16 + j shift, j dx, i dy from range(16) a(i), range(16) b(j)),
 k as (select shift, sum((least(a.x1,b.x1-dx)-greatest(a.x0,b.x0-dx)) * (least(a.y1,b.y1-dy)-greatest(a.y0,b.y0-dy))) shared
       from v_pred a join v_gt b on a.scene_id = b.scene_id and a.x0 < b.x1 and b.x0 - 15 < a.x1 and a.y0 < b.y1 and b.y0 - 15 < a.y1 cross join g
       where a.x0 < b.x1-dx and b.x0-dx < a.x1 and a.y0 < b.y1-dy and b.y0-dy < a.y1 group by 1)
select shift, cast(shared as bigint) shared from k order by shared desc, shift limit 10""", "v_pred", "v_gt")  # fmt: skip

_N = geo.FLAT / (2 - geo.FLAT)


def _utm_sql() -> tuple[str, str]:
    radius = geo.A_AXIS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
    alpha = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
    east = "eta" + "".join(f" + {a!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(alpha, 1))
    north = "xi" + "".join(f" + {a!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(alpha, 1))
    return f"500000e0 + {geo.K0 * radius!r} * ({east})", f"{geo.K0 * radius!r} * ({north})"


def _scene_corners() -> tuple[Column, Column, Column, Column]:
    return F.col("lon0"), F.col("lat1") - F.col("height_px") * F.col("res_deg"), F.col("lon0") + F.col("width_px") * F.col("res_deg"), F.col("lat1")


@_query
def q20_utm_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = view(spark, sf_dir, "v_scene")
    x0, y0, x1, y1 = _scene_corners()
    zone = geo.utm_zone((x0 + x1) / 2)
    boxed = s.withColumn("zone", zone).withColumn("geom", geo.box(x0, y0, x1, y1))
    metric = boxed.withColumn("utm", overlay.to_utm(F.col("geom"), F.col("zone")))
    return metric.select("scene_id", (F.col("zone") + 32600).cast("int").alias("epsg"), F.floor(geo.area(F.col("utm")) + 0.5).cast("long").alias("area_m2"), F.floor(geo.length(F.col("utm")) + 0.5).cast("long").alias("length_m"))


_E, _NO = _utm_sql()
_oracle("q20_utm_area", f"""
 k as (select scene_id, lon0 xa, lat1 - height_px * res_deg ya, lon0 + width_px * res_deg xb, lat1 yb from v_scene),
 v as (select scene_id, 0 i, xa lon, ya lat, (xa+xb)/2 mid from k union all select scene_id, 1, xb, ya, (xa+xb)/2 from k union all select scene_id, 2, xb, yb, (xa+xb)/2 from k union all select scene_id, 3, xa, yb, (xa+xb)/2 from k),
 z as (select *, floor((mid + 180) / 6) + 1 zone from v),
 u1 as (select *, radians(lon - (zone * 6 - 183)) dl, sinh(atanh(sin(radians(lat))) - {2 * _N**0.5 / (1 + _N)!r} * atanh({2 * _N**0.5 / (1 + _N)!r} * sin(radians(lat)))) t from z),
 u2 as (select *, atan(t / cos(dl)) xi, atanh(sin(dl) / sqrt(1 + t * t)) eta from u1),
 u as (select scene_id, i, zone, {_E} x, {_NO} y from u2),
 e as (select a.scene_id, a.zone, a.x * b.y - b.x * a.y w, sqrt((b.x-a.x)*(b.x-a.x) + (b.y-a.y)*(b.y-a.y)) l from u a join u b on a.scene_id = b.scene_id and b.i = (a.i + 1) % 4)
select scene_id, cast(max(zone) + 32600 as int) epsg, cast(floor(abs(sum(w)) / 2 + 0.5e0) as bigint) area_m2, cast(floor(sum(l) + 0.5e0) as bigint) length_m from e group by 1""", "v_scene")  # fmt: skip


@_query
def q21_aoi_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    x0, y0, x1, y1 = _scene_corners()
    s = view(spark, sf_dir, "v_scene")
    km2 = geo.scene_area_km2(x1 - x0, y1 - y0, (y0 + y1) / 2)
    return s.select("scene_id", "city", rules.split_of(F.col("scene_id"), (0, 3, 11, 13)).alias("split"), _scaled(km2, 1e5).alias("area_km2"))


_oracle("q21_aoi_area", "select scene_id, city, split, cast(floor(width_px*res_deg*111320e0*cos(radians((lat1 - height_px*res_deg + lat1)/2))*(height_px*res_deg)*110540e0/1e6 * 1e5 + 0.5e0) as bigint) area_km2 from v_scene", "v_scene")


def _l_ring() -> Column:
    """An L-shaped ring in a box."""
    x0, y0, x1, y1 = (F.col(c).cast("double") for c in spatial.BOX)
    mx, my = (x0 + x1) / 2, (y0 + y1) / 2
    pts = [(x0, y0), (x1, y0), (x1, my), (mx, my), (mx, y1), (x0, y1), (x0, y0)]
    return F.array(*[geo.point(x, y) for x, y in pts])


@_query
def q22_shoelace(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = view(spark, sf_dir, "v_pred").withColumn("geom", F.struct(F.lit("Polygon").alias("kind"), F.array(F.array(_l_ring())).alias("polys")))
    c = geo.ring_centroid(F.col("geom.polys")[0][0])
    return p.select("id", _scaled(geo.area(F.col("geom")), 100).alias("area"), _scaled(geo.length(F.col("geom")), 100).alias("perimeter"), _scaled(c["x"], 100).alias("cx"), _scaled(c["y"], 100).alias("cy"))


_oracle("q22_shoelace", """
 d as (select id, cast(x0 as double) x0, cast(y0 as double) y0, cast(x1-x0 as double) w, cast(y1-y0 as double) h from v_pred)
select id, cast(floor(w*h*0.75e0*100 + 0.5e0) as bigint) area, cast(floor((2*w+2*h)*100 + 0.5e0) as bigint) perimeter,
       cast(floor((x0 + w*5/12)*100 + 0.5e0) as bigint) cx, cast(floor((y0 + h*5/12)*100 + 0.5e0) as bigint) cy from d""", "v_pred")  # fmt: skip


@_query
def q23_snap_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slightly skewed quadrilateral in each box, snapped."""
    x0, y0, x1, y1 = (F.col(c).cast("double") for c in spatial.BOX)
    ring = F.array(geo.point(x0, y0), geo.point(x1, y0 + 1), geo.point(x1 + 1, y1), geo.point(x0, y1 + 2), geo.point(x0, y0))
    p = view(spark, sf_dir, "v_pred").withColumn("ring", ring).withColumn("snapped", geo.snap_ring(F.col("ring")))
    return p.select("id", F.posexplode("snapped").alias("k", "v")).select("id", "k", "v.x", "v.y")


_oracle("q23_snap_ring", """
 r as (select id, [struct_pack(x := cast(x0 as double), y := cast(y0 as double)), struct_pack(x := cast(x1 as double), y := cast(y0+1 as double)), struct_pack(x := cast(x1+1 as double), y := cast(y1 as double)), struct_pack(x := cast(x0 as double), y := cast(y1+2 as double))] p from v_pred),
 w(id, k, p, x, y) as (select id, 0, p, p[1].x, p[1].y from r union all
   select id, k + 1, p, case when abs(p[(k+1)%4+1].x - x) > abs(p[(k+1)%4+1].y - y) then p[(k+1)%4+1].x else x end, case when abs(p[(k+1)%4+1].x - x) > abs(p[(k+1)%4+1].y - y) then y else p[(k+1)%4+1].y end from w where k < 4),
 z as (select id, k, x, y from w union all select a.id, 5, b.x, b.y from w a join w b on a.id = b.id and a.k = 4 and b.k = 0 where a.x <> b.x or a.y <> b.y)
select id, cast(k as int) k, x, y from z""", "v_pred")  # fmt: skip


@_query
def q24_glcm(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.floor(px.intensity_u8(*_rgb()) / 8).cast("int")
    g = segments.glcm(view(spark, sf_dir, "v_pixel"), ["tile_id"], level)
    return g.select("tile_id", *[_scaled(F.col(c)).alias(c) for c in segments.GLCM])


_oracle("q24_glcm", """
 q as (select tile_id, prow, pcol, cast(floor(floor((r+g+b)/3)/8) as int) i from v_pixel),
 n as (select tile_id, i, lead(i) over (partition by tile_id, prow order by pcol) j from q),
 b as (select tile_id, i, j from n where j is not null union all select tile_id, j, i from n where j is not null),
 c as (select tile_id, i, j, cast(count(*) as double) n from b group by 1, 2, 3),
 s as (select tile_id, sum(n) t, sum(n*(i-j)*(i-j))/sum(n) con, sum(n/(1+(i-j)*(i-j)))/sum(n) hom, sum(n*n)/(sum(n)*sum(n)) energy, sum(n*abs(i-j))/sum(n) dis, sum(n*i)/sum(n) m, sum(n*i*i)/sum(n) q, sum(n*i*j)/sum(n) ij from c group by 1)
select tile_id, cast(floor(con*1e6+0.5e0) as bigint) glcm_contrast, cast(floor(hom*1e6+0.5e0) as bigint) glcm_homogeneity, cast(floor(energy*1e6+0.5e0) as bigint) glcm_asm,
   cast(floor(case when q-m*m < 1e-15 then 1 else (ij-m*m)/(q-m*m) end*1e6+0.5e0) as bigint) glcm_correlation, cast(floor(dis*1e6+0.5e0) as bigint) glcm_dissimilarity from s""", "v_pixel")  # fmt: skip


@_query
def q25_hsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, s, v = px.hsv(*_rgb())
    return view(spark, sf_dir, "v_pixel").groupBy("tile_id").agg(*[F.sum(F.floor(c * 1e4 + 0.5).cast("long")).alias(n) for n, c in (("h", h), ("s", s), ("v", v))])


_oracle("q25_hsv", """
 n as (select tile_id, r/255 r, g/255 g, b/255 b, greatest(r,g,b)/255 t, greatest(r,g,b)/255 - least(r,g,b)/255 d from v_pixel),
 k as (select tile_id, case when d = 0 then 0e0 when t = r then (g-b)/d when t = g then 2+(b-r)/d else 4+(r-g)/d end / 6 h, case when t = 0 then 0e0 else d/t end s, t v from n)
select tile_id, cast(sum(floor((h - floor(h))*1e4+0.5e0)) as bigint) h, cast(sum(floor(s*1e4+0.5e0)) as bigint) s, cast(sum(floor(v*1e4+0.5e0)) as bigint) v from k group by 1""", "v_pixel")  # fmt: skip


@_query
def q26_layer_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = view(spark, sf_dir, "v_pred").drop("id").withColumn("class", F.lit("house"))
    return schema.completed(p, "survey", ["y0", "x0", "x1", "y1"], prefix="bld", scope=["scene_id"], date="2026-04-01")


_oracle("q26_layer_schema", """select format('bld_{:06d}', row_number() over (partition by scene_id order by y0, x0, x1, y1) - 1) id, 'house' class, cast(80 as int) confidence, 'survey' source,
  '2026-04-01' date, cast(null as varchar) change_flag, scene_id, x0, y0, x1, y1 from v_pred""", "v_pred")  # fmt: skip


@_query
def q27_affine(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tiles.tiles(view(spark, sf_dir, "v_scene"))
    zero = F.lit(0.0)
    t = [F.col("res_deg"), zero, F.col("lon0"), zero, -F.col("res_deg"), F.col("lat1")]
    b = geo.window_bounds(F.col("col_off"), F.col("row_off"), F.col("width"), F.col("height"), t)
    return s.select("scene_id", F.col("tile_idx").cast("long").alias("tile_idx"), *[_scaled(b[c], 1e8).alias(c) for c in spatial.BOX])


_oracle("q27_affine", " t as (" + _TILES_SQL + """)
select t.scene_id, tile_idx, cast(floor((res_deg*col_off + lon0)*1e8+0.5e0) as bigint) x0, cast(floor((-res_deg*(row_off+height) + lat1)*1e8+0.5e0) as bigint) y0,
  cast(floor((res_deg*(col_off+width) + lon0)*1e8+0.5e0) as bigint) x1, cast(floor((-res_deg*row_off + lat1)*1e8+0.5e0) as bigint) y1 from t join v_scene using (scene_id)""", "v_scene")  # fmt: skip


@_query
def q28_area_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    scenes = view(spark, sf_dir, "v_scene").filter("split = 'holdout'").select("scene_id")
    boxes = schema.concat(view(spark, sf_dir, "v_pred").select("scene_id", *spatial.BOX, F.lit("a").alias("layer")), view(spark, sf_dir, "v_gt").select("scene_id", *spatial.BOX, F.lit("b").alias("layer")))
    areas = spatial.union_areas(boxes.join(F.broadcast(scenes), "scene_id", "left_semi"))  # scenes are few by definition
    q = metrics.area_quality(scenes.join(areas, "scene_id", "left").withColumn("aoi_m2", F.lit(1050.0 * 1050.0)))
    return q.select("scene_id", *[_scaled(F.col(c), 1).alias(c) for c in ("tp_m2", "fp_m2", "fn_m2", "tn_m2")], *[_scaled(F.col(c)).alias(c) for c in ("area_precision", "area_recall", "area_f1", "area_accuracy")])


_oracle("q28_area_metrics", """
 h as (select scene_id from v_scene where split = 'holdout'),
 ca as (select distinct scene_id, x, y from v_pred join h using (scene_id), range(0, 1050) a(x), range(0, 1050) b(y) where x >= x0 and x < x1 and y >= y0 and y < y1),
 cb as (select distinct scene_id, x, y from v_gt join h using (scene_id), range(0, 1050) a(x), range(0, 1050) b(y) where x >= x0 and x < x1 and y >= y0 and y < y1),
 k as (select h.scene_id, count(ca.x) filter (cb.x is not null) tp, count(ca.x) filter (cb.x is null) fp, count(cb.x) filter (ca.x is null) fn
       from h left join (ca full join cb on ca.scene_id = cb.scene_id and ca.x = cb.x and ca.y = cb.y) on h.scene_id = coalesce(ca.scene_id, cb.scene_id) group by 1),
 m as (select *, greatest(0, 1102500 - tp - fp - fn) tn, tp/(tp+fp+1e-9) p, tp/(tp+fn+1e-9) r from k)
select scene_id, tp tp_m2, fp fp_m2, fn fn_m2, tn tn_m2, cast(floor(p*1e6+0.5e0) as bigint) area_precision, cast(floor(r*1e6+0.5e0) as bigint) area_recall,
  cast(floor(2*p*r/(p+r+1e-9)*1e6+0.5e0) as bigint) area_f1, cast(floor((tp+tn)/(tp+fp+fn+tn+1e-9)*1e6+0.5e0) as bigint) area_accuracy from m""", "v_scene", "v_pred", "v_gt")  # fmt: skip


@_query
def q29_val_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = view(spark, sf_dir, "v_scene").filter("split = 'train'").select("scene_id")
    return schema.seeded_split(s, "scene_id")


_oracle("q29_val_split", """
 t as (select scene_id, row_number() over (order by substr(md5(concat_ws('|', '42', cast(scene_id as varchar))), 1, 15), scene_id) k, count(*) over () n from v_scene where split = 'train')
select scene_id, k <= greatest(1, n // 8) is_val from t""", "v_scene")  # fmt: skip


@_query
def q30_morphology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strong red opened and closed, tile rows throughout."""
    tiles_ = tile_rows(spark, sf_dir)
    parts = []
    for radius in (1, 3):
        on = segments.cleaned(F.transform("r", lambda v: v > 110), F.col("width"), radius)
        out = tiles_.select("tile_id", on.alias("m"))
        places = F.aggregate(F.transform("m", lambda m, i: F.when(m, i).otherwise(0)), F.lit(0).cast("long"), lambda s, x: s + x)
        parts.append(out.select("tile_id", F.lit(radius).alias("radius"), F.size(F.filter("m", lambda m: m)).cast("long").alias("n_on"), places.alias("places")))
    return schema.concat(*parts)


_oracle("q30_morphology", "m0 as materialized (select tile_id, pos, prow, pcol, cast(r > 110 as int) m from v_pixel), " + _cleaned_sql("m0", 1, ("m",), "x") + ", " + _cleaned_sql("m0", 3, ("m",), "y") + """
select tile_id, cast(1 as int) radius, cast(sum(m) as bigint) n_on, cast(sum(m * pos) as bigint) places from x group by 1 union all select tile_id, 3, cast(sum(m) as bigint), cast(sum(m * pos) as bigint) from y group by 1""", "v_pixel")  # fmt: skip


@_query
def q31_dice_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = view(spark, sf_dir, "v_prob").withColumn("logit", (F.col("p") - 0.4) * 8).withColumn("truth", F.col("p") > 0.5)
    loss = metrics.segmentation_loss(p, "tile_id", "logit", "truth")
    return loss.select(*[_scaled(F.col(c)).alias(c) for c in ("loss", "dice", "bce")])


_oracle("q31_dice_loss", """
 k as (select tile_id, (p - 0.4e0) * 8 x, cast(p > 0.5e0 as int) t from v_prob),
 s as (select tile_id, sum(greatest(x, 0) - x*t + ln(1 + exp(-abs(x)))) bce, count(*) n, sum(t/(1+exp(-x))) pt, sum(1/(1+exp(-x)) + t) ps from k group by 1),
 f as (select sum(bce)/sum(n) bce, avg((2*pt+1)/(ps+1)) dice, avg(1-(2*pt+1)/(ps+1)) miss from s)
select cast(floor((bce + 0.5e0*miss)*1e6+0.5e0) as bigint) loss, cast(floor(dice*1e6+0.5e0) as bigint) dice, cast(floor(bce*1e6+0.5e0) as bigint) bce from f""", "v_prob")  # fmt: skip


def _spread(df: DataFrame) -> DataFrame:
    """The test tables are single files: their rows go to all cores before heavy work."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def _turned_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted boxes with a vertex of noise, turned by the id's degrees about a corner."""
    x0, y0, x1, y1 = (F.col(c).cast("double") for c in spatial.BOX)
    ring = F.array(geo.point(x0, y0), geo.point((x0 + x1) / 2, y0 + 0.3), geo.point(x1, y0), geo.point(x1, y1), geo.point(x0, y1), geo.point(x0, y0))
    return view(spark, sf_dir, "v_pred").withColumn("geom", geo.rotate(F.struct(F.lit("Polygon").alias("kind"), F.array(F.array(ring)).alias("polys")), (F.col("id") % 45).cast("double"), x0, y0))


@_query
def q32_ortho_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noisy turned rectangles, regularised: the rectangles themselves."""
    out = overlay.ortho_snapped(_spread(_turned_boxes(spark, sf_dir).select("id", "geom")), tolerance=0.5)
    return out.select("id", _scaled(geo.area(F.col("geom")), 1e3).alias("area_m2"), (F.size(F.col("geom.polys")[0][0]) - 1).alias("n_vertices"))


_oracle("q32_ortho_snap", "select id, cast((x1-x0)*(y1-y0)*1000 as bigint) area_m2, cast(4 as int) n_vertices from v_pred", "v_pred")


@_query
def q33_slic(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments.superpixels(view(spark, sf_dir, "v_pixel").select("tile_id", "prow", "pcol", "r", "g", "b", "valid"), ["tile_id"], n_segments=4)
    return s.filter("segment_id > 0").groupBy("tile_id", "segment_id").agg(F.count(F.lit(1)).alias("area_px"))


@_query
def q34_rf(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = segments.color_features(_masked(spark, sf_dir, 1), ["tile_id", "scene_id"]).withColumn("label", (F.col("scene_id") % 2).cast("double"))
    names = [c for c in f.columns if c not in ("tile_id", "scene_id", "label")]
    return ml.cross_validated(f, names, "tile_id", folds=2, numTrees=10, maxDepth=6)


@_query
def q35_city_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = metrics.compare_cities(metrics.city_summary(_metrics(spark, sf_dir)), "A", "B")
    return c.select("metric", _micro("a"), _micro("b"), _micro("delta"), "better", _micro("bar_a"), _micro("bar_b"), "decimals")


_CITY = {"buildings": "sum(n_buildings_total)", "cars": "sum(n_cars)", "cars_per_km2": "avg(cars_density_per_km2)", "buildings_pct": "avg(buildings_share_of_aoi_pct)", "vegetation_pct": "avg(vegetation_share_pct)", "soil_pct": "avg(bare_soil_share_pct)", "concrete": "avg(buildings_share_of_aoi_pct - vegetation_share_pct)"}
_oracle("q35_city_comparison", _METRICS_SQL + ", c as (" + " union all ".join(f"select '{n}' metric, {str(n == 'concrete').lower()} low, cast({e} filter (city = 'A') as double) a, cast({e} filter (city = 'B') as double) b from m" for n, e in _CITY.items()) + """),
 d as (select *, a - b d, case when low then b - a else a - b end ahead, case when greatest(abs(a), abs(b)) > 0 then greatest(abs(a), abs(b)) else 1 end s from c)
select metric, cast(floor(a*1e3+0.5e0) as bigint) a, cast(floor(b*1e3+0.5e0) as bigint) b, cast(floor(d*1e3+0.5e0) as bigint) delta, case when ahead > 0 then 'A' when ahead < 0 then 'B' else '=' end better,
  cast(floor(abs(a)/s*1e3+0.5e0) as bigint) bar_a, cast(floor(abs(b)/s*1e3+0.5e0) as bigint) bar_b, cast(case when abs(d) >= 1 then 1 else 2 end as int) decimals from d""", "v_scene", "v_pred", "v_det", "v_gt")  # fmt: skip


@_query
def q36_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = metrics.totals(_metrics(spark, sf_dir))
    return t.select("buildings", "cars", *[_micro(c) for c in ("area_km2", "buildings_pct", "vegetation_pct", "soil_pct", "other_pct")])


_oracle("q36_totals", _METRICS_SQL + """,
 t as (select cast(sum(n_buildings_total) as bigint) buildings, cast(sum(n_cars) as bigint) cars, sum(aoi_area_km2) area_km2, 100*sum(buildings_total_area_m2)/sum(aoi_area_km2*1e6) bp,
   100*sum(vegetation_area_m2)/sum(aoi_area_km2*1e6) vp, 100*sum(bare_soil_area_m2)/sum(aoi_area_km2*1e6) sp from m)
select buildings, cars, cast(floor(area_km2*1e3+0.5e0) as bigint) area_km2, cast(floor(bp*1e3+0.5e0) as bigint) buildings_pct, cast(floor(vp*1e3+0.5e0) as bigint) vegetation_pct,
  cast(floor(sp*1e3+0.5e0) as bigint) soil_pct, cast(floor((100-bp-vp-sp)*1e3+0.5e0) as bigint) other_pct from t""", "v_scene", "v_pred", "v_det", "v_gt")  # fmt: skip


def _boxed(df: DataFrame) -> DataFrame:
    return df.withColumn("geom", geo.box(*[F.col(c) for c in spatial.BOX]))


@_query
def q37_polygon_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The polygon path on rectangles: labels as by boxes."""
    pred, gt = (_boxed(view(spark, sf_dir, v)) for v in ("v_pred", "v_gt"))
    out = spatial.overlap_labels(pred, gt, polygons=True)
    return out.select("scene_id", "id", _scaled(F.col("overlap")).alias("overlap"), F.col("label").cast("int").alias("label"), "ref_class", "ref_subtype")


_SQL["q37_polygon_overlap"] = _SQL["q02_overlap_label"]


@_query
def q38_cover_minus_buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References as land cover, without the predicted buildings of their scene."""
    cover, built = (_boxed(view(spark, sf_dir, v)).select("scene_id", "id", "geom") for v in ("v_gt", "v_pred"))
    out = overlay.subtracted(cover, built)
    return out.select("scene_id", "id", _scaled(geo.area(F.col("geom")), 1).alias("area_m2"))


_oracle("q38_cover_minus_buildings", """
 g as (select scene_id, id, x, y from (select scene_id, id, x1, y0, y1, unnest(range(x0, x1)) x from v_gt), lateral (select unnest(range(y0, y1)) y)),
 k as (select g.scene_id, g.id, count(*) a from g where not exists (select 1 from v_pred p where p.scene_id = g.scene_id and g.x >= p.x0 and g.x < p.x1 and g.y >= p.y0 and g.y < p.y1) group by 1, 2)
select scene_id, id, a area_m2 from k where a > 5 or scene_id not in (select scene_id from v_pred)""", "v_pred", "v_gt")  # fmt: skip


@_query
def q39_patch_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference footprints drawn into 64-pixel patches."""
    ids = spark.range(20).select(F.col("id").alias("scene_id")).crossJoin(spark.range(256).select("id"))
    patches = ids.withColumn("x0", (F.col("id") % 16) * 64).withColumn("y0", F.floor(F.col("id") / 16) * 64).withColumn("x1", F.col("x0") + 64).withColumn("y1", F.col("y0") + 64)
    out = overlay.rasterized(patches, _boxed(view(spark, sf_dir, "v_gt")), 64)
    on = F.length(F.replace(F.hex("mask"), F.lit("00"), F.lit(""))) / 2
    return out.select("scene_id", "id", on.cast("long").alias("n_on")).filter("n_on > 0")


_oracle("q39_patch_masks", """
 g as (select distinct scene_id, x, y from (select scene_id, x1, y0, y1, unnest(range(x0, x1)) x from v_gt), lateral (select unnest(range(y0, y1)) y))
select scene_id, (y // 64) * 16 + x // 64 id, count(*) n_on from g where x < 1024 and y < 1024 group by 1, 2""", "v_gt")  # fmt: skip


@_query
def q40_polygon_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L-shaped polygons cut to four scenes."""
    layer = view(spark, sf_dir, "v_pred").withColumn("geom", F.struct(F.lit("Polygon").alias("kind"), F.array(F.array(_l_ring())).alias("polys"))).select("id", "geom")
    out = overlay.clipped(layer, _cross_boxes(spark))
    return out.select("scene_id", "id", _scaled(geo.area(F.col("geom")), 100).alias("area"))


_oracle("q40_polygon_clip", """
 b as (select i scene_id, (i % 2) * 450 x0, (i // 2) * 450 y0, (i % 2) * 450 + 550 x1, (i // 2) * 450 + 550 y1 from range(4) t(i)),
 r as (select id, cast(x0 as double) x0, cast(y0 as double) y0, cast(x1 as double) x1, (y0+y1)/2e0 y1 from v_pred union all select id, x0, (y0+y1)/2e0, (x0+x1)/2e0, y1 from v_pred),
 c as (select b.scene_id, r.id, sum(greatest(0, least(r.x1, b.x1) - greatest(r.x0, b.x0)) * greatest(0, least(r.y1, b.y1) - greatest(r.y0, b.y0))) a from r, b group by 1, 2)
select scene_id, id, cast(floor(a * 100 + 0.5e0) as bigint) area from c where a > 0""", "v_pred")  # fmt: skip



@_query
def q41_training_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of at least a patch with the starts of a seeded and of the central crop, and the dataset's length."""
    t = tiles.training_tiles(view(spark, sf_dir, "v_scene"), 600, 256)
    n = tiles.dataset_length(F.count(F.lit(1)).over(Window.partitionBy("scene_id")), 4, True)
    return t.select(
        "scene_id", F.col("col_off").cast("long").alias("col_off"), F.col("row_off").cast("long").alias("row_off"), tiles.crop_offset(F.col("width"), 256, 7, "scene_id", "col_off", "row_off").alias("seeded"),
        tiles.crop_offset(F.col("width"), 256, 7, centre=True).alias("central"), n.alias("n_patches"),
    )


_oracle("q41_training_tiles", """
 t as (select scene_id, c col_off, r row_off, least(600, width_px - c) w, least(600, height_px - r) h from v_scene, range(0, 10000, 600) x(c), range(0, 10000, 600) y(r) where c < width_px and r < height_px),
 k as (select * from t where w >= 256 and h >= 256)
select scene_id, col_off, row_off, cast('0x' || substr(md5(concat_ws('|', '7', cast(scene_id as varchar), cast(col_off as varchar), cast(row_off as varchar))), 1, 15) as bigint) % (w - 255) seeded,
  (w - 256) // 2 central, 4 * count(*) over (partition by scene_id) n_patches from k""", "v_scene")  # fmt: skip


@_query
def q42_city_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    x0, y0, x1, y1 = _scene_corners()
    boxes = view(spark, sf_dir, "v_scene").select("city", *[c.alias(n) for c, n in zip((x0, y0, x1, y1), spatial.BOX)])
    return tiles.padded_bounds(boxes, ["city"]).select("city", *[_scaled(F.col(c)).alias(c) for c in spatial.BOX])


_oracle("q42_city_bounds", """select city, cast(floor((min(lon0) - 0.002e0)*1e6+0.5e0) as bigint) x0, cast(floor((min(lat1 - height_px*res_deg) - 0.002e0)*1e6+0.5e0) as bigint) y0,
 cast(floor((max(lon0 + width_px*res_deg) + 0.002e0)*1e6+0.5e0) as bigint) x1, cast(floor((max(lat1) + 0.002e0)*1e6+0.5e0) as bigint) y1 from v_scene group by 1""", "v_scene")  # fmt: skip


@_query
def q43_layer_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Available and renamed columns, stale labels dropped, segment ids over tiles, finite features, text nulls."""
    g = view(spark, sf_dir, "v_gt").withColumn("bbox-0", F.col("x0")).withColumn("label", F.lit(9)).withColumn("tile_idx", F.col("id") % 7)
    g = schema.renamed(g, {"class": "kind", "num_floors": "floors"})
    g = schema.drop_present(schema.keep_available(g, ["id", "kind", "subtype", "floors", "height", "label", "tile_idx"]), "label", "overlap")
    return g.select("id", schema.text_or_null(F.col("kind")).alias("kind"), schema.global_segment_id(F.col("tile_idx"), F.col("id")).alias("segment_id"), schema.finite(F.col("floors")).alias("floors"), F.lit(len(g.columns)).alias("n_columns"))


_oracle("q43_layer_columns", """select id, case when class not in ('None', 'nan') then class end kind, (id % 7) * 100000 + id segment_id, case when num_floors is null or isnan(num_floors) then 0e0 else num_floors end floors, cast(5 as int) n_columns from v_gt""", "v_gt")


def _kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes as polygons, points, empty and missing geometries in turn."""
    g = view(spark, sf_dir, "v_gt")
    box, none = geo.box(*[F.col(c) for c in spatial.BOX]), F.lit(None).cast(geo.GEOM)
    dot = F.struct(F.lit("Point").alias("kind"), F.array(F.array(F.array(geo.point(F.col("x0"), F.col("y0"))))).alias("polys"))
    empty = F.struct(F.lit("Polygon").alias("kind"), F.slice(box["polys"], 1, 0).alias("polys"))
    return g.withColumn("geom", F.when(F.col("id") % 4 == 0, dot).when(F.col("id") % 4 == 1, empty).when(F.col("id") % 4 == 2, none).otherwise(box))


@_query
def q44_geometry_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Present polygons of at least 30 m2, with the mean of their corners."""
    g = _kinds(spark, sf_dir).filter(geo.is_polygonal(F.col("geom")) & geo.is_present(F.col("geom")))
    kept = overlay.large_buildings(g, 90.0)
    c = geo.corners_centre(F.slice(F.col("geom.polys")[0][0], 1, 4))
    return kept.select("scene_id", "id", _scaled(c["x"], 10).alias("cx"), _scaled(c["y"], 10).alias("cy"))


_oracle("q44_geometry_filters", "select scene_id, id, cast(floor((x0+x1)*5e0+0.5e0) as bigint) cx, cast(floor((y0+y1)*5e0+0.5e0) as bigint) cy from v_gt where id % 4 = 3 and (x1-x0)*(y1-y0) >= 90", "v_gt")


@_query
def q45_patch_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.good_patches(view(spark, sf_dir, "v_pixel"), ["tile_id"], 0.97).select("tile_id", _scaled(F.col("valid_share")).alias("valid_share"))


_oracle("q45_patch_validity", "select tile_id, cast(floor(avg(cast(valid as int))*1e6+0.5e0) as bigint) valid_share from v_pixel group by 1 having avg(cast(valid as int)) >= 0.97e0", "v_pixel")


@_query
def q46_number_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("id") - 700) * 12_345
    return view(spark, sf_dir, "v_pred").select("id", metrics.spaced(n).alias("whole"), metrics.percent(n / 8.0, 1).alias("share"))


_oracle("q46_number_format", """select id, replace(replace(format('{:,}', (id-700)*12345), ',', ' '), '-', '−') whole, replace(replace(format('{:,.1f}', (id-700)*12345/8e0), '-', '−'), '', '') || '%' share from v_pred""", "v_pred")


@_query
def q47_network_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Network input, where pixels go under flips and turns, probabilities, percents and detector classes."""
    p = view(spark, sf_dir, "v_pixel")
    row, col = px.augmented(F.col("prow"), F.col("pcol"), 8, F.col("tile_id") % 2 == 0, F.col("tile_id") % 3 == 0, F.col("tile_id"))
    prob = px.sigmoid((px.scaled(F.col("r"), F.col("valid")) - 0.4) * 6)
    out = p.select("tile_id", row.alias("row"), col.alias("col"), prob.alias("p"), px.detected_class((F.col("pos") % 12).cast("int")).alias("cls"))
    return out.groupBy("tile_id").agg(F.sum(_scaled(F.col("p"), 1e4) * (F.col("row") * 8 + F.col("col") + 1)).alias("placed"), F.sum(px.confidence_pct(F.floor(F.col("p") * 1e4) / 1e4).cast("long")).alias("percents"), F.count_if(F.col("cls") == "car").alias("cars"), F.count("cls").alias("kept"))


_oracle("q47_network_values", """
 f as (select tile_id, pos, case when tile_id % 3 = 0 then 7 - prow else prow end r, case when tile_id % 2 = 0 then 7 - pcol else pcol end c, 1/(1+exp(-((case when valid then v_pixel.r/255 else 0 end) - 0.4e0)*6)) p from v_pixel),
 t as (select *, case tile_id % 4 when 0 then r when 1 then 7 - c when 2 then 7 - r else c end rr, case tile_id % 4 when 0 then c when 1 then r when 2 then 7 - c else 7 - r end cc from f)
select tile_id, cast(sum(cast(floor(p*1e4+0.5e0) as bigint) * (rr*8+cc+1)) as bigint) placed, cast(sum(cast(round_even(floor(p*1e4)/1e4*100, 0) as bigint)) as bigint) percents,
 count(*) filter (pos % 12 = 10) cars, count(*) filter (pos % 12 in (9, 10)) kept from t group by 1""", "v_pixel")  # fmt: skip


@_query
def q48_move_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null-safe translation, and turns about the centroid that keep area and length."""
    g = _kinds(spark, sf_dir)
    moved = geo.translate(F.col("geom"), F.lit(-2.0), F.col("id") % 5 * 1.0)
    c = geo.ring_centroid(F.col("geom.polys")[0][0])
    b, turned = geo.bounds(moved), geo.rotate(F.col("geom"), F.lit(30.0), c["x"], c["y"])
    rows = g.filter(F.col("id") % 4 >= 2).select("id", b["x0"].cast("long").alias("x0"), b["y1"].cast("long").alias("y1"), _scaled(geo.area(turned), 100).alias("area"), _scaled(geo.length(turned), 100).alias("length"))
    return rows


_oracle("q48_move_turn", """select id, case when id % 4 = 3 then cast(x0 - 2 as bigint) end x0, case when id % 4 = 3 then cast(y1 + id % 5 as bigint) end y1, case when id % 4 = 3 then cast((x1-x0)*(y1-y0)*100 as bigint) end area,
 case when id % 4 = 3 then cast((x1-x0+y1-y0)*200 as bigint) end length from v_gt where id % 4 >= 2""", "v_gt")  # fmt: skip


@_query
def q49_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bow ties in boxes: two triangles, half of the box."""
    x0, y0, x1, y1 = (F.col(c) for c in spatial.BOX)
    tie = F.array(geo.point(x0, y0), geo.point(x1, y1), geo.point(x1, y0), geo.point(x0, y1), geo.point(x0, y0))
    g = view(spark, sf_dir, "v_pred").withColumn("geom", F.struct(F.lit("Polygon").alias("kind"), F.array(F.array(tie)).alias("polys")))
    return overlay.repaired(_spread(g)).select("id", _scaled(geo.area(F.col("geom")), 100).alias("area"))


_oracle("q49_repair", "select id, cast((x1-x0)*(y1-y0)*50 as bigint) area from v_pred", "v_pred")


@_query
def q50_simplify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The noisy vertex of turned boxes goes; the main direction is the longer side's."""
    from geoloom.operators import outline

    out = overlay.simplified(_spread(_turned_boxes(spark, sf_dir)), 0.5)
    angle = outline.principal_angle(F.col("geom"))
    turned = F.pmod(F.round(angle - F.col("id") % 45, 6), F.lit(180.0))
    return out.select("id", (F.size(F.col("geom.polys")[0][0]) - 1).alias("n_vertices"), F.when(F.col("x1") - F.col("x0") != F.col("y1") - F.col("y0"), F.pmod(F.round(turned), F.lit(180.0)).cast("long")).alias("angle"))


_oracle("q50_simplify", "select id, cast(4 as int) n_vertices, case when x1-x0 > y1-y0 then cast(0 as bigint) when x1-x0 < y1-y0 then 90 end angle from v_pred", "v_pred")


def _on(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each tile's pixels with a label: 1 where red is strong, 2 where it is weak."""
    return view(spark, sf_dir, "v_pixel").withColumn("segment_id", F.when(F.col("r") > 110, 1).otherwise(2))


@_query
def q51_label_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label rasters as polygons: their areas are the pixels'."""
    out = segments.polygons(_on(spark, sf_dir).select("tile_id", "prow", "pcol", "segment_id"), ["tile_id"])
    polys = F.array(F.transform("rings", lambda r: F.transform(r, lambda v: geo.point(v["x"], v["y"]))))
    shaped = out.withColumn("geom", F.struct(F.lit("Polygon").alias("kind"), polys.alias("polys")))
    return shaped.groupBy("tile_id", "segment_id").agg(F.count(F.lit(1)).alias("n_pieces"), _scaled(F.sum(geo.area(F.col("geom"))), 1).alias("area_px"), _scaled(F.sum(geo.length(F.col("geom"))), 1).alias("outline_px"))


_oracle("q51_label_polygons", """
 s as (select tile_id, pos, prow, pcol, cast(case when r > 110 then 1 else 2 end as int) segment_id from v_pixel),
 w(tile_id, segment_id, root, pos, prow, pcol) as (select tile_id, segment_id, pos, pos, prow, pcol from s
   union select w.tile_id, w.segment_id, w.root, s.pos, s.prow, s.pcol from w join s on s.tile_id = w.tile_id and s.segment_id = w.segment_id and abs(s.prow - w.prow) + abs(s.pcol - w.pcol) = 1),
 c as (select tile_id, segment_id, pos, min(root) piece from w group by 1, 2, 3),
 e as (select a.tile_id, a.pos, 4 - count(b.pos) free from s a left join s b on a.tile_id = b.tile_id and a.segment_id = b.segment_id and abs(a.prow - b.prow) + abs(a.pcol - b.pcol) = 1 group by 1, 2)
select tile_id, segment_id, count(distinct piece) n_pieces, count(*) area_px, cast(sum(free) as bigint) outline_px from c join e using (tile_id, pos) group by 1, 2""", "v_pixel")  # fmt: skip


@_query
def q52_footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positive regions of probability tiles, with the mean probability of the whole tile."""
    p = view(spark, sf_dir, "v_pixel").select("tile_id", "prow", "pcol", (F.col("r") / 255).alias("p"))
    out = overlay.footprints(p, ["tile_id"])
    return out.groupBy("tile_id").agg(_scaled(F.sum(geo.area(F.col("geom"))), 1).alias("area_px"), _scaled(F.max("mean_p"), 1e4).alias("mean_p"))


_oracle("q52_footprints", "select tile_id, count(*) filter (r/255 >= 0.5e0) area_px, cast(floor(avg(r/255)*1e4+0.5e0) as bigint) mean_p from v_pixel group by 1 having count(*) filter (r/255 >= 0.5e0) > 0", "v_pixel")


@_query
def q53_segment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by overlap, use for training and the scenes' label counts."""
    f = segments.color_features(_masked(spark, sf_dir, 1), ["tile_id", "scene_id"])
    f = f.withColumn("label", F.when(F.col("tile_id") % 3 == 0, 1).when(F.col("tile_id") % 3 == 1, 0).otherwise(-1)).withColumn("label", F.when(F.col("scene_id") % 2 == 0, F.col("label")))
    summary = metrics.segment_summary(f.withColumn("tile_idx", F.col("tile_id")))
    used = f.filter(spatial.usable_for_training()).groupBy("scene_id").agg(F.count(F.lit(1)).alias("n_train"))
    return summary.join(used, "scene_id", "left")


_oracle("q53_segment_summary", _seg(1) + """,
 l as (select *, case when scene_id % 2 = 0 then case tile_id % 3 when 0 then 1 when 1 then 0 else -1 end end lab from f)
select scene_id, count(distinct tile_id) n_tiles, count(*) n_segments, case when count(lab) > 0 then count(*) filter (lab = 1) end n_pos, case when count(lab) > 0 then count(*) filter (lab = 0) end n_neg,
 nullif(count(*) filter (coalesce(lab, 0) <> -1 and not (frac_vegetation > 0.5e0 or frac_shadow > 0.5e0 or frac_soil > 0.5e0)), 0) n_train from l group by 1""", "v_pixel")  # fmt: skip


@_query
def q54_building_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = view(spark, sf_dir, "v_pred").withColumn("area_m2", spatial.box_area().cast("double")).withColumn("class", F.when(F.col("area_m2") <= 250, "house").otherwise("apartment_block")).withColumn("confidence", (F.col("id") % 101).cast("int"))
    s = metrics.building_summary(b)
    return s.select("scene_id", "n_buildings_total", "n_house", "n_apartment_block", *[_micro(c) for c in ("total_area_m2", "mean_area_m2", "mean_confidence")])


_oracle("q54_building_summary", """
 b as (select scene_id, id, cast((x1-x0)*(y1-y0) as double) a from v_pred)
select scene_id, count(*) n_buildings_total, count(*) filter (a <= 250) n_house, count(*) filter (a > 250) n_apartment_block, cast(floor(sum(a)*1e3+0.5e0) as bigint) total_area_m2, cast(floor(avg(a)*1e3+0.5e0) as bigint) mean_area_m2,
 cast(floor(avg(id % 101)*1e3+0.5e0) as bigint) mean_confidence from b group by 1""", "v_pred")  # fmt: skip


@_query
def q55_segment_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = segments.shape_features(_on(spark, sf_dir), ["tile_id", "segment_id"]).withColumn("perimeter_px", 4 * F.sqrt("area_px"))
    f = segments.with_compactness(f)
    return f.select("tile_id", "segment_id", "area_px", *[_scaled(F.col(c), 1e4).alias(c) for c in ("extent", "major_axis_len", "minor_axis_len", "eccentricity", "shape_index", "compactness")])


_oracle("q55_segment_shape", """
 s as (select tile_id, cast(case when r > 110 then 1 else 2 end as int) segment_id, cast(prow as double) r, cast(pcol as double) c from v_pixel),
 m as (select tile_id, segment_id, count(*) area_px, count(*) / ((max(r)-min(r)+1)*(max(c)-min(c)+1)) extent, var_pop(r)+1/12e0 rr, var_pop(c)+1/12e0 cc, covar_pop(r, c) rc from s group by 1, 2),
 a as (select *, (rr+cc+sqrt((rr-cc)*(rr-cc)+4*rc*rc))/2 big, greatest((rr+cc-sqrt((rr-cc)*(rr-cc)+4*rc*rc))/2, 0) small from m)
select tile_id, segment_id, area_px, cast(floor(extent*1e4+0.5e0) as bigint) extent, cast(floor(4*sqrt(big)*1e4+0.5e0) as bigint) major_axis_len, cast(floor(4*sqrt(small)*1e4+0.5e0) as bigint) minor_axis_len,
 cast(floor(sqrt(1-small/big)*1e4+0.5e0) as bigint) eccentricity, cast(floor(4*sqrt(area_px)/(4*sqrt(area_px+1e-6))*1e4+0.5e0) as bigint) shape_index, cast(floor(4*pi()*area_px/(16*area_px+1e-6)*1e4+0.5e0) as bigint) compactness from a""", "v_pixel")  # fmt: skip


@_query
def q56_city_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _metrics(spark, sf_dir)
    out, top = metrics.city_peaks(m), metrics.peak(m, "n_cars").select(F.col("scene_id").alias("top_scene"))
    return out.join(F.broadcast(top), F.lit(True)).select("city", _micro("mean"), _micro("mean_density"), "peak_scene", "peak", "top_scene")  # one row


_oracle("q56_city_peaks", _METRICS_SQL + """,
 p as (select city, avg(n_cars) mean, avg(buildings_density_per_km2) mean_density, max(n_cars) peak, arg_max(scene_id, n_cars * 1000 - scene_id) peak_scene from m group by 1)
select city, cast(floor(mean*1e3+0.5e0) as bigint) mean, cast(floor(mean_density*1e3+0.5e0) as bigint) mean_density, peak_scene, peak, (select scene_id from m order by n_cars desc, scene_id limit 1) top_scene from p""", "v_scene", "v_pred", "v_det", "v_gt")  # fmt: skip


@_query
def q57_sorted_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of report rows: scenes with the aggregate at the end, classes by name, splits."""
    counts = spatial.match_objects(view(spark, sf_dir, "v_pred"), view(spark, sf_dir, "v_gt"))
    place = lambda df, what, name: spark.createDataFrame([(what, i, str(r[0])) for i, r in enumerate(df.select(name).collect())], "report string, place int, name string")  # noqa: E731  a report's rows
    last = place(metrics.aggregate_last(metrics.with_aggregate(counts)), "scenes", "scene_id")
    kinds = place(schema.distinct_classes(view(spark, sf_dir, "v_gt")), "classes", "class")
    splits = schema.split_counts(view(spark, sf_dir, "v_scene")).select(F.lit("splits").alias("report"), F.col("n_scenes").cast("int").alias("place"), F.col("split").alias("name"))
    return schema.concat(last, kinds, splits)


_oracle("q57_sorted_reports", """
 s as (select distinct cast(scene_id as varchar) n from (select scene_id from v_pred union select scene_id from v_gt))
select 'scenes' report, cast(row_number() over (order by n = 'AGGREGATE', n) - 1 as int) place, n as "name" from (select n from s union all select 'AGGREGATE')
union all select 'classes', cast(row_number() over (order by class) - 1 as int), class from (select distinct class from v_gt where class is not null)
union all select 'splits', cast(count(*) as int), split from v_scene group by split""", "v_pred", "v_gt", "v_scene")  # fmt: skip


@_query
def q58_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Oriented boxes to points of two classes, duplicates suppressed."""
    d = view(spark, sf_dir, "v_det").withColumn("class_no", (F.col("id") % 12).cast("int")).withColumn("conf", F.col("conf") / 100)
    x, y = F.col("x"), F.col("y")
    corners = F.array(geo.point(x - 1, y - 2), geo.point(x + 3, y - 2), geo.point(x + 3, y + 4), geo.point(x - 1, y + 4))
    raw = d.select("scene_id", "id", "class_no", "conf", corners.alias("corners"), F.lit(100).alias("col_off"), F.lit(50).alias("row_off"))
    one, zero = F.lit(0.5), F.lit(0.0)
    out = ml.detections(raw, [one, zero, F.lit(7.0), zero, -one, F.lit(9.0)])
    return out.select("scene_id", "id", "cls", "confidence", _scaled(F.col("lon"), 1e3).alias("lon"), _scaled(F.col("lat"), 1e3).alias("lat"))


_oracle("q58_detections", """select scene_id, id, case id % 12 when 10 then 'car' else 'large_vehicle' end cls, cast(conf as int) confidence, cast(floor(((100 + x + 1)*0.5e0 + 7)*1e3+0.5e0) as bigint) lon, cast(floor(((50 + y + 1)*-0.5e0 + 9)*1e3+0.5e0) as bigint) lat
 from v_det where id % 12 in (9, 10) and conf/100e0 >= 0.25e0""", "v_det")  # fmt: skip


@_query
def q59_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid patches through a pluggable function, averaged to a mosaic and cut at a threshold."""
    p = view(spark, sf_dir, "v_pixel")
    kept = p.join(tiles.good_patches(p, ["tile_id"], 0.9).select("tile_id"), "tile_id", "left_semi")
    out = ml.infer(kept.select("scene_id", "tile_id", "prow", "pcol", "r"), lambda pdf: (pdf["r"] / 255) ** 2)
    placed = out.select("scene_id", ((F.col("tile_id") % 10) * 6 + F.col("prow")).alias("arow"), ((F.floor(F.col("tile_id") / 10) % 10) * 6 + F.col("pcol")).alias("acol"), "p")
    m = tiles.mosaic(placed, ["scene_id", "arow", "acol"], threshold=0.3)
    return m.groupBy("scene_id").agg(F.count(F.lit(1)).alias("n_places"), F.sum(_scaled(F.col("p"), 1e4)).alias("p"), F.count_if(_scaled(F.col("p"), 1e4) >= 3000).alias("n_on"))


_oracle("q59_inference", """
 k as (select tile_id from v_pixel group by 1 having avg(cast(valid as int)) >= 0.9e0),
 m as (select scene_id, (tile_id % 10)*6 + prow arow, (cast(floor(tile_id/10) as bigint) % 10)*6 + pcol acol, avg((r/255)*(r/255)) p from v_pixel where tile_id in (select tile_id from k) group by 1, 2, 3)
select scene_id, count(*) n_places, cast(sum(cast(floor(p*1e4+0.5e0) as bigint)) as bigint) p, count(*) filter (cast(floor(p*1e4+0.5e0) as bigint) >= 3000) n_on from m group by 1""", "v_pixel")  # fmt: skip


@_query
def q60_land_cover_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Land-cover classes of segments with each of their pieces; of the pieces' labels the last one counts."""
    f = segments.color_features(_masked(spark, sf_dir, 1), ["tile_id"]).withColumnRenamed("tile_id", "segment_id")
    cover = rules.land_cover(f, 0.4).select("segment_id", "class", "confidence")
    pieces = view(spark, sf_dir, "v_gt").select((F.col("id") % 700).alias("segment_id"), F.col("id").alias("piece"), spatial.box_area().alias("area_m2"))
    joined = schema.joined_features(cover, pieces)
    last = spatial.last_piece(pieces.withColumn("label", F.col("piece") % 2)).select("segment_id", F.col("label").alias("last_label"))
    return joined.join(last, "segment_id", "left").select("segment_id", "class", "confidence", "piece", "area_m2", "last_label")


_oracle("q60_land_cover_pieces", _seg(1) + """,
 c as (select tile_id segment_id, 'vegetation' class, cast(round_even(frac_vegetation * 100, 0) as int) confidence from f where frac_vegetation >= 0.4e0
  union all select tile_id, 'bare_soil', cast(round_even(frac_soil * 100, 0) as int) from f where frac_soil >= 0.4e0),
 g as (select id % 700 segment_id, id piece, (x1-x0)*(y1-y0) area_m2, max(id) over (partition by id % 700) % 2 last_label from v_gt)
select c.segment_id, class, confidence, piece, area_m2, last_label from c left join g using (segment_id)""", "v_pixel", "v_gt")  # fmt: skip


def _l_shaped(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return view(spark, sf_dir, name).withColumn("geom", F.struct(F.lit("Polygon").alias("kind"), F.array(F.array(_l_ring())).alias("polys")))


_L_SQL = """
 l as (select 'a' side, scene_id, id, cast(x0 as double) x0, cast(y0 as double) y0, cast(x1 as double) x1, (y0+y1)/2e0 y1 from v_pred union all select 'a', scene_id, id, x0, (y0+y1)/2e0, (x0+x1)/2e0, y1 from v_pred
  union all select 'b', scene_id, id, x0, y0, x1, (y0+y1)/2e0 from v_gt union all select 'b', scene_id, id, x0, (y0+y1)/2e0, (x0+x1)/2e0, y1 from v_gt)"""


@_query
def q61_polygon_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L-shaped objects: those of one scene that touch, and their shared areas."""
    a, b = (_l_shaped(spark, sf_dir, v).select("scene_id", "id", "geom") for v in ("v_pred", "v_gt"))
    return overlay.touching(a, b).select("a", "b", _scaled(F.col("shared"), 100).alias("shared"))


_oracle("q61_polygon_match", _L_SQL + """
select p.id a, q.id b, cast(floor(sum(greatest(0, least(p.x1, q.x1) - greatest(p.x0, q.x0)) * greatest(0, least(p.y1, q.y1) - greatest(p.y0, q.y0)))*100+0.5e0) as bigint) shared
from l p join l q on p.side = 'a' and q.side = 'b' and p.scene_id = q.scene_id and p.x0 <= q.x1 and q.x0 <= p.x1 and p.y0 <= q.y1 and q.y0 <= p.y1 group by 1, 2""".replace("\nselect", " select", 1), "v_pred", "v_gt")  # fmt: skip


@_query
def q62_polygon_unions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union areas of L-shaped layers of the hold-out scenes."""
    scenes = view(spark, sf_dir, "v_scene").filter("split = 'holdout'").select("scene_id")
    every = [_l_shaped(spark, sf_dir, v).select("scene_id", "geom", F.lit(n).alias("layer")) for v, n in (("v_pred", "a"), ("v_gt", "b"))]
    areas = overlay.union_areas(schema.concat(*every).join(F.broadcast(scenes), "scene_id", "left_semi"))  # scenes are few by definition
    return areas.select("scene_id", *[_scaled(F.col(c), 4).alias(c) for c in ("area_a", "area_b", "area_ab")])


_oracle("q62_polygon_unions", _L_SQL + """,
 h as (select scene_id from v_scene where split = 'holdout'),
 c as (select distinct side, scene_id, x, y from l join h using (scene_id), range(0, 2100) i(x), range(0, 2100) j(y) where x/2e0 >= x0 and x/2e0 < x1 and y/2e0 >= y0 and y/2e0 < y1),
 k as (select scene_id, x, y, bool_or(side = 'a') a, bool_or(side = 'b') b from c group by 1, 2, 3)
select scene_id, count(*) filter (a) area_a, count(*) filter (b) area_b, count(*) filter (a and b) area_ab from k group by 1""", "v_pred", "v_gt", "v_scene")  # fmt: skip


@_query
def q63_inverse_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scene corners to UTM and back."""
    x0, y0, x1, y1 = _scene_corners()
    s = view(spark, sf_dir, "v_scene").withColumn("zone", geo.utm_zone(x0)).withColumn("geom", geo.box(x0, y0, x1, y1))
    there = s.withColumn("geom", overlay.to_utm(F.col("geom"), F.col("zone")))
    back = there.withColumn("geom", overlay.to_wgs84(F.col("geom"), F.col("zone")))
    b = geo.bounds(F.col("geom"))
    return back.select("scene_id", geo.utm_epsg(x0).alias("epsg"), *[_scaled(b[c], 1e8).alias(c) for c in spatial.BOX])


_oracle("q63_inverse_projection", """select scene_id, cast(floor((lon0 + 180)/6) + 32601 as int) epsg, cast(floor(lon0*1e8+0.5e0) as bigint) x0, cast(floor((lat1 - height_px*res_deg)*1e8+0.5e0) as bigint) y0,
 cast(floor((lon0 + width_px*res_deg)*1e8+0.5e0) as bigint) x1, cast(floor(lat1*1e8+0.5e0) as bigint) y1 from v_scene""", "v_scene")  # fmt: skip


@_query
def q64_train_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of unlike size, by epoch."""
    steps = view(spark, sf_dir, "v_pred").select((F.col("id") % 9).alias("epoch"), ((F.col("id") % 97) / 8.0).alias("loss"), (F.col("id") % 5 + 1).alias("n"))
    return metrics.mean_loss(steps).select("epoch", _scaled(F.col("train_loss")).alias("train_loss"))


_oracle("q64_train_loss", "select id % 9 epoch, cast(floor(sum((id % 97)/8e0 * (id % 5 + 1))/sum(id % 5 + 1)*1e6+0.5e0) as bigint) train_loss from v_pred group by 1", "v_pred")



@_query
def q65_geojson_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Footprints in UTM, written as GeoJSON (back in WGS 84) by class and read again."""
    s = view(spark, sf_dir, "v_scene").select("scene_id", "lon0", "lat1")
    lon, lat = (lambda c: F.col("lon0") + F.col(c) * 1e-5), (lambda c: F.col("lat1") - F.col(c) * 1e-5)
    p = view(spark, sf_dir, "v_pred").filter("scene_id < 10").join(F.broadcast(s), "scene_id")
    p = p.select("id", F.when(F.col("id") % 3 == 0, "house").when(F.col("id") % 3 == 1, "shed").alias("class"), geo.box(lon("x0"), lat("y1"), lon("x1"), lat("y0")).alias("geom"))
    folder = work_path(spark, "layers")
    paths = geojson.write_by_class(p.withColumn("geom", overlay.to_utm(F.col("geom"), F.lit(43))), folder, "building", epsg=32643)
    parts = [geojson.read(spark, path, {"id": "bigint", "class": "string"}) for path in paths]
    b = geo.bounds(F.col("geom"))
    return schema.concat(*parts).select("id", "class", F.lit(len(paths)).alias("n_layers"), *[_scaled(b[c], 1e7).alias(c) for c in spatial.BOX], geojson.ring_is_closed(F.col("geom.polys")[0][0]).alias("closed"), geojson.valid_position(b["x0"], b["y0"]).alias("placed"))


_oracle("q65_geojson_layers", """select id, case id % 3 when 0 then 'house' else 'shed' end class, cast(2 as int) n_layers, cast(floor((lon0 + x0*1e-5)*1e7+0.5e0) as bigint) x0, cast(floor((lat1 - y1*1e-5)*1e7+0.5e0) as bigint) y0,
 cast(floor((lon0 + x1*1e-5)*1e7+0.5e0) as bigint) x1, cast(floor((lat1 - y0*1e-5)*1e7+0.5e0) as bigint) y1, true closed, true placed from v_pred join (select scene_id, lon0, lat1 from v_scene) using (scene_id) where scene_id < 10 and id % 3 < 2""", "v_pred", "v_scene")  # fmt: skip


@_query
def q66_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features by scene, a report as CSV with a fallback, a table written once, a missing one, buildings of a box."""
    folder = work_path(spark, "tables")
    p = view(spark, sf_dir, "v_pred")
    tables.write_features(p, f"{folder}/features")
    tables.write_csv(p.groupBy("scene_id").agg(F.count(F.lit(1)).alias("n")), f"{folder}/report")
    for more in (p.limit(0), p):  # the second is not written
        tables.write_once(more, f"{folder}/once")
    report = tables.read_csv(spark, "scene_id bigint, n bigint", f"{folder}/none", f"{folder}/report")
    near = tables.read_buildings(spark, f"{folder}/features", 100, 200, 500, 600).groupBy("scene_id").agg(F.count(F.lit(1)).alias("n_near"))
    kept, missing = tables.read_or_empty(spark, f"{folder}/once", "id bigint").count(), tables.read_or_empty(spark, f"{folder}/gone", "id bigint").count()
    return report.join(near.select(F.col("scene_id").cast("long").alias("scene_id"), "n_near"), "scene_id", "left").select("scene_id", "n", "n_near", F.lit(kept).cast("long").alias("n_once"), F.lit(missing).cast("long").alias("n_missing"))


_oracle("q66_tables", "select scene_id, count(*) n, nullif(count(*) filter (x1 >= 100 and x0 <= 500 and y1 >= 200 and y0 <= 600), 0) n_near, cast(0 as bigint) n_once, cast(0 as bigint) n_missing from v_pred group by 1", "v_pred")


@_query
def q67_geopackage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two layers of a GeoPackage, written on the driver, put on shared storage and read again."""
    import tempfile

    path = work_path(spark, "package") + ".gpkg"
    boxes = _boxed(view(spark, sf_dir, "v_pred")).select("id", "scene_id", "geom")
    dots = _kinds(spark, sf_dir).filter("id % 4 = 0").select("id", "subtype", "geom")
    with tempfile.TemporaryDirectory() as folder:  # the driver's own file until it is put
        n = geopackage.write_layer(boxes, f"{folder}/a.gpkg", "buildings") + geopackage.write_layer(dots, f"{folder}/a.gpkg", "cars")
        store.put(spark, f"{folder}/a.gpkg", path)
    a = geopackage.read_layer(spark, path, "buildings", {"id": "bigint", "scene_id": "bigint"})
    b = geopackage.read_layer(spark, path, "cars", {"id": "bigint", "subtype": "string"})
    every = schema.concat(a.withColumn("layer", F.lit("buildings")), b.withColumn("layer", F.lit("cars")))
    e = geo.bounds(F.col("geom"))
    return every.select("layer", "id", "scene_id", "subtype", F.lit(n).cast("long").alias("n_written"), *[e[c].cast("long").alias(c) for c in spatial.BOX])


_oracle("q67_geopackage", """
 n as (select (select count(*) from v_pred) + (select count(*) from v_gt where id % 4 = 0) n_written)
select 'buildings' layer, id, scene_id, cast(null as varchar) subtype, n_written, cast(x0 as bigint) x0, cast(y0 as bigint) y0, cast(x1 as bigint) x1, cast(y1 as bigint) y1 from v_pred, n
union all select 'cars', id, null, subtype, n_written, x0, y0, x0, y0 from v_gt, n where id % 4 = 0""", "v_pred", "v_gt")  # fmt: skip


@_query
def q68_scene_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles as GeoTIFF files: their headers, and their pixels read in overlapping windows whose overlap is dropped."""
    folder = work_path(spark, "scenes")
    byte = lambda v: F.lpad(F.hex(v.cast("int")), 2, "0")
    rgb = F.unhex(F.array_join(F.transform(F.arrays_zip("r", "g", "b"), lambda p: F.concat(byte(p["r"]), byte(p["g"]), byte(p["b"]))), ""))
    valid = F.unhex(F.array_join(F.transform("valid", lambda v: F.when(v, "01").otherwise("00")), ""))
    t = F.array(F.lit(0.5), F.lit(0.0), F.lit(70.0) + F.col("tile_id") % 16, F.lit(0.0), F.lit(-0.25), F.lit(43.0))
    rows = tile_rows(spark, sf_dir).select("tile_id", F.concat(F.lit(f"{folder}/"), F.col("tile_id"), F.lit(".tif")).alias("path"), F.col("width").alias("width"), F.lit(8).alias("height"), t.alias("transform"), rgb.alias("rgb"), valid.alias("valid"))
    paths = saved(raster.write_scenes(rows), "scene-paths").select("path")
    number = F.regexp_extract("path", r"(\d+)\.tif$", 1).cast("long")
    head = raster.metadata(paths).select(number.alias("tile_id"), "bands", "dtype", "epsg", "utm_epsg", *[_scaled(F.col(c), 100).alias(c) for c in spatial.BOX])
    cells = raster.pixels(raster.read_tiles(paths, 5, 2)).join(raster.read_tiles(paths, 5, 2).select("path", "tile_idx", "col_off", "row_off"), ["path", "tile_idx"])
    own = cells.filter(tiles.owned(F.col("prow"), F.col("pcol"), F.col("row_off"), F.col("col_off"), 2))
    place = (F.col("row_off") + F.col("prow")) * 8 + F.col("col_off") + F.col("pcol") + 1
    sums = own.groupBy(number.alias("tile_id")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(c) * place).alias(c) for c in "rgb"], F.count_if("valid").alias("n_valid"))
    return head.join(sums, "tile_id")


_oracle("q68_scene_files", """
 p as (select tile_id, count(*) n, cast(sum(v_pixel.r*(pos+1)) as bigint) r, cast(sum(g*(pos+1)) as bigint) g, cast(sum(b*(pos+1)) as bigint) b, count(*) filter (valid) n_valid from v_pixel group by 1)
select tile_id, cast(4 as int) bands, 'uint8' dtype, cast(4326 as int) epsg, cast(32601 + floor((72 + tile_id % 16 + 180) / 6) as int) utm_epsg, cast(7000 + tile_id % 16 * 100 as bigint) x0, cast(4100 as bigint) y0, cast(7400 + tile_id % 16 * 100 as bigint) x1, cast(4300 as bigint) y1,
 n, r, g, b, n_valid from p""", "v_pixel")  # fmt: skip



@_query
def q69_segment_texture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outline, co-occurrence and binary patterns of segments in their bounding boxes."""
    f = segments.texture_and_outline(_on(spark, sf_dir).select("tile_id", "prow", "pcol", "r", "g", "b", "segment_id"), ["tile_id"])
    n = _on(spark, sf_dir).groupBy("tile_id", "segment_id").agg(F.count(F.lit(1)).alias("n"))
    return f.join(n, ["tile_id", "segment_id"]).select("tile_id", "segment_id", _scaled(F.col("perimeter_px"), 1e4).alias("perimeter_px"), *[F.floor(F.col(c) * 1e4 + 0.5000001).cast("long").alias(c) for c in segments.GLCM], *[F.round(F.col(f"lbp_h{i}") * F.col("n")).cast("long").alias(f"lbp_h{i}") for i in range(10)])


def _texture_sql() -> str:
    diagonal = 0.70711
    # the neighbours at distance 1, counter-clockwise from the right, as weighted pixels (row, column, weight)
    looks = []
    for k in range(8):
        dy, dx = ((0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1))[k]
        if dy == 0 or dx == 0:
            looks.append([(dy, dx, 1.0)])
        else:
            near, far = diagonal, 1 - diagonal
            looks.append([(0, 0, far * far), (0, dx, far * near), (dy, 0, near * far), (dy, dx, near * near)])
    offsets = sorted({(dy, dx) for look in looks for dy, dx, _ in look})
    name = lambda dy, dx: f"l{dy + 1}{dx + 1}"
    joins = " ".join(f"left join bx {name(*o)} on {name(*o)}.tile_id = a.tile_id and {name(*o)}.segment_id = a.segment_id and {name(*o)}.y = a.y + {o[0]} and {name(*o)}.x = a.x + {o[1]}" for o in offsets)
    bits = ", ".join(f"cast({' + '.join(f'coalesce({name(dy, dx)}.l, 0) * {w!r}' for dy, dx, w in look)} >= a.l - 1e-9 as int) b{k}" for k, look in enumerate(looks))
    inside = lambda dy, dx: f"coalesce({name(dy, dx)}.m, 0)"
    straight = ((-1, 0), (1, 0), (0, -1), (0, 1))
    return f"""
 s as materialized (select tile_id, prow, pcol, cast(case when r > 110 then 1 else 2 end as int) seg, (r+g+b)/3 l from v_pixel),
 bb as (select tile_id, seg segment_id, min(prow) r0, max(prow) r1, min(pcol) c0, max(pcol) c1, count(*) n, cast(floor(avg(floor(l))) as int) mean from s group by 1, 2),
 bx as materialized (select bb.tile_id, segment_id, prow - r0 y, pcol - c0 x, l, cast(seg = segment_id as int) m, n, cast(floor(case when seg = segment_id then floor(l) else mean end / 8) as int) q from bb join s on s.tile_id = bb.tile_id and prow between r0 and r1 and pcol between c0 and c1),
 nb as materialized (select a.tile_id, a.segment_id, a.y, a.x, a.m, a.n, {bits}, cast(a.m = 1 and ({' + '.join(inside(*o) for o in straight)}) < 4 as int) border from bx a {joins}),
 u as (select *, (b0 + b1 + b2 + b3 + b4 + b5 + b6 + b7) ones, cast(b0 <> b7 as int) + cast(b1 <> b0 as int) + cast(b2 <> b1 as int) + cast(b3 <> b2 as int) + cast(b4 <> b3 as int) + cast(b5 <> b4 as int) + cast(b6 <> b5 as int) + cast(b7 <> b6 as int) turns from nb),
 lb as (select tile_id, segment_id, {', '.join(f"count(*) filter (m = 1 and n >= 4 and (case when turns <= 2 then ones else 9 end) = {i}) lbp_h{i}" for i in range(10))} from u group by 1, 2),
 k as (select a.tile_id, a.segment_id, a.y, a.x, 1 + 2 * sum(case when abs(b.y - a.y) + abs(b.x - a.x) = 1 then b.border else 0 end) + 10 * sum(case when abs(b.y - a.y) = 1 and abs(b.x - a.x) = 1 then b.border else 0 end) kind
   from nb a join nb b on a.tile_id = b.tile_id and a.segment_id = b.segment_id and abs(a.y - b.y) <= 1 and abs(a.x - b.x) <= 1 where a.border = 1 group by 1, 2, 3, 4),
 pm as (select tile_id, segment_id, sum(case when kind in (5, 7, 15, 17, 25, 27) then 1 when kind in (21, 33) then sqrt(2) when kind in (13, 23) then (1 + sqrt(2)) / 2 else 0 end) p from k group by 1, 2),
 g0 as (select a.tile_id, a.segment_id, a.q i, b.q j from bx a join bx b on a.tile_id = b.tile_id and a.segment_id = b.segment_id and a.y = b.y and b.x = a.x + 1 where a.n >= 4),
 g1 as (select tile_id, segment_id, i, j, cast(count(*) as double) n from (select * from g0 union all select tile_id, segment_id, j, i from g0) group by 1, 2, 3, 4),
 g2 as (select tile_id, segment_id, sum(n*(i-j)*(i-j))/sum(n) con, sum(n/(1+(i-j)*(i-j)))/sum(n) hom, sum(n*n)/(sum(n)*sum(n)) energy, sum(n*abs(i-j))/sum(n) dis, sum(n*i)/sum(n) m, sum(n*i*i)/sum(n) q, sum(n*i*j)/sum(n) ij from g1 group by 1, 2)
select bb.tile_id, bb.segment_id, cast(floor(coalesce(p, 0)*1e4+0.5e0) as bigint) perimeter_px, cast(floor(coalesce(con, 0)*1e4+0.5000001e0) as bigint) glcm_contrast, cast(floor(coalesce(hom, 0)*1e4+0.5000001e0) as bigint) glcm_homogeneity, cast(floor(coalesce(energy, 0)*1e4+0.5000001e0) as bigint) glcm_asm,
 cast(floor(case when bb.n < 4 then 0 when m is null or q-m*m < 1e-15 then 1 else (ij-m*m)/(q-m*m) end*1e4+0.5000001e0) as bigint) glcm_correlation, cast(floor(coalesce(dis, 0)*1e4+0.5000001e0) as bigint) glcm_dissimilarity, {', '.join(f'lbp_h{i}' for i in range(10))}
from bb join lb using (tile_id, segment_id) left join pm using (tile_id, segment_id) left join g2 using (tile_id, segment_id)"""


_oracle("q69_segment_texture", _texture_sql(), "v_pixel")


@_query
def q70_superpixel_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Superpixels label the valid pixels, and only these, gaplessly from 1."""
    s = segments.superpixels(view(spark, sf_dir, "v_pixel").select("tile_id", "prow", "pcol", "r", "g", "b", "valid"), ["tile_id"], n_segments=4)
    return s.groupBy("tile_id").agg(F.count_if(F.col("segment_id") > 0).alias("n_labelled"), F.count_if((F.col("segment_id") > 0) != F.col("valid")).alias("n_wrong"), (F.max("segment_id") == F.size(F.collect_set(F.when(F.col("segment_id") > 0, F.col("segment_id"))))).alias("gapless"))


_oracle("q70_superpixel_labels", "select tile_id, count(*) filter (valid) n_labelled, cast(0 as bigint) n_wrong, true gapless from v_pixel group by 1", "v_pixel")


def _shifts(spark: SparkSession) -> DataFrame:
    return tiles.shift_grid(spark).select((F.col("i") * 16 + F.col("j")).alias("shift"), F.col("j").alias("dx"), F.col("i").alias("dy"))


@_query
def q71_shift_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training labels that each of the 256 shifts gives."""
    pred, refs = view(spark, sf_dir, "v_pred").select("scene_id", "id", *spatial.BOX), view(spark, sf_dir, "v_gt").select("scene_id", *spatial.BOX)
    return ml.shift_counts(pred, ml.shifted_boxes(pred, refs, _shifts(spark)), _shifts(spark))


_oracle("q71_shift_labels", """
 g as (select i * 16 + j shift, j dx, i dy from range(16) a(i), range(16) b(j)),
 o as (select shift, a.id, sum((least(a.x1,b.x1-dx)-greatest(a.x0,b.x0-dx)) * (least(a.y1,b.y1-dy)-greatest(a.y0,b.y0-dy))) / cast(max((a.x1-a.x0)*(a.y1-a.y0)) as double) f
       from v_pred a join v_gt b on a.scene_id = b.scene_id and a.x0 < b.x1 and b.x0 - 15 < a.x1 and a.y0 < b.y1 and b.y0 - 15 < a.y1 cross join g
       where a.x0 < b.x1-dx and b.x0-dx < a.x1 and a.y0 < b.y1-dy and b.y0-dy < a.y1 group by 1, 2),
 k as (select shift, count(*) filter (f > 0.05e0 and f < 0.5e0) unclear, count(*) filter (f >= 0.5e0) pos from o group by 1)
select g.shift, (select count(*) from v_pred) - coalesce(unclear, 0) n_train, coalesce(pos, 0) n_pos from g left join k using (shift)""", "v_pred", "v_gt")  # fmt: skip


@_query
def q72_forest_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forests on the labels of two shifts: the rows they saw, and that each quality is a share."""
    pred, refs = view(spark, sf_dir, "v_pred").select("scene_id", "id", *spatial.BOX), view(spark, sf_dir, "v_gt").select("scene_id", *spatial.BOX)
    f = pred.withColumns({"w": (F.col("x1") - F.col("x0")).cast("double"), "h": (F.col("y1") - F.col("y0")).cast("double"), "x": F.col("x0").cast("double")})
    out = ml.calibrated(f, refs, _shifts(spark).filter("shift in (0, 119)"), ["w", "h", "x"], folds=2, numTrees=5, maxDepth=4)
    sound = F.lit(True)
    for c in ("accuracy", "precision", "recall", "f1"):
        sound = sound & F.coalesce(F.col(c).between(0, 1), F.lit(True))
    return out.select("shift", "n_train", "n_pos", sound.alias("sound"))


_SQL["q72_forest_calibration"] = "select *, true sound from (" + _SQL["q71_shift_labels"] + ") where shift in (0, 119)"


@_query
def q73_numbered_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids over all rows of a layer without one."""
    p = view(spark, sf_dir, "v_pred").withColumn("was", F.col("id")).drop("id")
    return schema.completed(p, "survey", ["was"], prefix="bld").select("id", "was", "class", "confidence")


_oracle("q73_numbered_layer", "select format('bld_{:06d}', row_number() over (order by id) - 1) id, id was, 'building' class, cast(80 as int) confidence from v_pred", "v_pred")



@_query
def q74_segment_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole segment stage: every valid pixel is in one segment, polygons cover what the features count, the
    reference over the upper half of each tile labels the segments above and below."""
    t = tile_rows(spark, sf_dir).withColumn("tile_idx", F.col("tile_id"))
    features, pieces = segment_stage.segment_layer(t, ["scene_id", "tile_idx"], n_segments=4)
    k = (F.col("id") % 3).cast("int")
    refs = spark.range(10).select(F.col("id").alias("scene_id"), F.lit(1).cast("long").alias("id"), geo.box(F.lit(0), F.lit(0), F.lit(8), 2 + k * 2).alias("geom"), F.lit("house").alias("class"), F.lit("residential").alias("subtype"))
    out = segment_stage.labelled(features, pieces, refs)
    shapes = pieces.groupBy("scene_id", "segment_id").agg(F.sum(geo.area(F.col("geom"))).alias("drawn"))
    sound = (F.col("drawn") == F.col("area_px")) & F.col("label").isin(-1, 0, 1) & (F.col("ref_class").isNotNull() == (F.col("label") == 1)) & (F.col("overlap").between(0, 1 + 1e-9)) & (F.col("use_for_train") | (F.col("label") < 2))
    return out.join(shapes, ["scene_id", "segment_id"]).groupBy("scene_id", F.floor(F.col("segment_id") / 100_000).alias("tile_idx")).agg(F.sum("area_px").alias("n_pixels"), _scaled(F.sum(F.col("overlap") * F.col("area_px")), 1).alias("n_covered"), F.min(sound).alias("sound"))


_oracle("q74_segment_stage", "select scene_id, tile_id tile_idx, count(*) filter (valid) n_pixels, count(*) filter (valid and prow < 2 + scene_id % 3 * 2) n_covered, true sound from v_pixel group by 1, 2", "v_pixel")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_ALL)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
