"""Polygon overlay on the geometry struct: Arrow functions refine the pairs that the cell join leaves."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions import geometry as geo
from geoloom.functions import kernels as k
from geoloom.operators import spatial
from geoloom.session import saved

MIN_BUILDING_M2, SLIVER_M2 = 30.0, 5.0


def _decoded(geoms: pa.StructArray) -> list[list[k.Rings]]:
    """Geometry structs as multipolygons of vertex arrays, sliced from the flat coordinates; null is empty."""
    polys = geoms.field("polys")
    rings, verts = polys.values, polys.values.values
    flat = verts.values
    xy = np.stack([flat.field(c).to_numpy(zero_copy_only=False).astype(float) for c in "xy"], 1)
    o0, o1, o2 = (a.offsets.to_numpy() for a in (polys, rings, verts))
    there = (geoms.is_valid().to_numpy(zero_copy_only=False)) & (polys.is_valid().to_numpy(zero_copy_only=False))
    return [[[xy[o2[r] : o2[r + 1]] for r in range(o1[p], o1[p + 1])] for p in range(o0[i], o0[i + 1])] if there[i] else [] for i in range(len(geoms))]


def _lists(many: pa.ListArray) -> list[list[list[k.Rings]]]:
    """Lists of geometries; null is empty."""
    flat, at, there = _decoded(many.values), many.offsets.to_numpy(), many.is_valid().to_numpy(zero_copy_only=False)
    return [flat[at[i] : at[i + 1]] if there[i] else [] for i in range(len(many))]


def _encoded(values: list[list[k.Rings]]) -> pa.StructArray:
    """Multipolygons as geometry structs; those without a polygon have null fields."""
    polys = [p for m in values for p in m]
    rings = [r for p in polys for r in p]
    xy = np.concatenate(rings) if rings else np.zeros((0, 2))
    ends = lambda sizes: pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32), pa.int32())
    vertices = pa.StructArray.from_arrays([pa.array(xy[:, 0].copy(), pa.float64()), pa.array(xy[:, 1].copy(), pa.float64())], ["x", "y"])
    out = pa.ListArray.from_arrays(ends([len(r) for r in rings]), vertices)
    out = pa.ListArray.from_arrays(ends([len(p) for p in polys]), out)
    out = pa.ListArray.from_arrays(ends([len(m) for m in values]), out, mask=pa.array([not m for m in values], pa.bool_()))
    kinds = pa.array([None if not m else "Polygon" if len(m) == 1 else "MultiPolygon" for m in values], pa.string())
    return pa.StructArray.from_arrays([kinds, out], ["kind", "polys"])


def _once(function):
    """A function that the optimizer does not copy into filters, where it would run a second time."""
    return function.asNondeterministic()


def intersection_area(a: Column, b: Column) -> Column:
    @F.arrow_udf("double")
    def run(p: pa.Array, q: pa.Array) -> pa.Array:
        known: dict[tuple[bytes, ...], np.ndarray | None] = {}  # a shape meets many others
        return pa.array([k.intersection_area(x, y, known) for x, y in zip(_decoded(p), _decoded(q))], pa.float64())

    return _once(run)(a, b)


def intersects(a: Column, b: Column) -> Column:
    """Closed: touching counts."""

    @F.arrow_udf("boolean")
    def run(p: pa.Array, q: pa.Array) -> pa.Array:
        return pa.array([any(k.intersects(r, s) for r in x for s in y) for x, y in zip(_decoded(p), _decoded(q))], pa.bool_())

    return _once(run)(a, b)


def touching(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a, b, shared): the ids of rows (scene_id, id, geom) of one scene whose geometries touch, and their shared area.
    Copies of a geometry are compared once; their rows are put in afterwards."""
    shapes = [saved(with_bounds(x.select("scene_id", "geom").distinct()).withColumn("shape", F.monotonically_increasing_id()), "shapes") for x in (a, b)]
    pairs = spatial.spread(spatial.box_pairs(*shapes), "l_shape", "r_shape").filter(intersects(F.col("l_geom"), F.col("r_geom")))
    pairs = pairs.select(F.col("l_shape").alias("ka"), F.col("r_shape").alias("kb"), intersection_area(F.col("l_geom"), F.col("r_geom")).alias("shared"))
    for side, rows, shape in (("a", a, shapes[0]), ("b", b, shapes[1])):
        # many shapes make a small file, but are too large for a broadcast
        of = rows.select("scene_id", "id", "geom").join(shape.hint("shuffle_hash"), ["scene_id", "geom"]).select(F.col("shape").alias(f"k{side}"), F.col("id").alias(side))
        pairs = pairs.join(of, f"k{side}")
    return pairs.select("a", "b", "shared")


def _mapped(df: DataFrame, column: str, change) -> DataFrame:
    """`df` with the geometry column changed multipolygon by multipolygon; empty results are null."""

    @F.arrow_udf(geo.GEOM)
    def run(g: pa.Array) -> pa.Array:
        return _encoded([change(x) if x else [] for x in _decoded(g)])

    out = df.withColumn(column, _once(run)(F.col(column)))
    return out.withColumn(column, F.when(F.col(f"{column}.polys").isNotNull(), F.col(column)))


def repaired(df: DataFrame, column: str = "geom") -> DataFrame:
    """Even-odd pieces of geometries whose rings may cross themselves."""
    return _mapped(df, column, lambda m: [[t] for t in k.repaired(m)])


def simplified(df: DataFrame, tolerance: float, column: str = "geom") -> DataFrame:
    return _mapped(df, column, lambda m: [[k.simplify_safely(r, tolerance) for r in rings] for rings in m])


def ortho_snapped(df: DataFrame, tolerance: float = 1.0, min_area: float = 5.0, column: str = "geom") -> DataFrame:
    """Regularised footprints part by part; rows of which nothing is left go."""
    out = _mapped(df, column, lambda m: [p for rings in m for p in k.ortho_snap(rings, tolerance, min_area)])
    return out.filter(geo.is_present(F.col(column)))


def to_utm(geom: Column, zone: Column) -> Column:
    return geo.map_vertices(geom, lambda v: geo.utm_forward_point(v["x"], v["y"], zone))


def to_wgs84(geom: Column, zone: Column) -> Column:
    return geo.map_vertices(geom, lambda v: geo.utm_inverse_point(v["x"], v["y"], zone))


def with_bounds(df: DataFrame, geometry: str = "geom") -> DataFrame:
    b = geo.bounds(F.col(geometry))
    return df.withColumns({c: b[c] for c in spatial.BOX})


def clipped(layer: DataFrame, scenes: DataFrame, geometry: str = "geom") -> DataFrame:
    """Polygon rows cut to every scene box they meet (scene_id, x0, y0, x1, y1); what only touches a box goes."""
    one = F.lit(0)
    pairs = spatial.box_pairs(with_bounds(layer.drop("scene_id"), geometry).withColumn("all", one), scenes.select("scene_id", *spatial.BOX).withColumn("all", one), "all")

    @F.arrow_udf(geo.GEOM)
    def cut(g: pa.Array, x0: pa.Array, y0: pa.Array, x1: pa.Array, y1: pa.Array) -> pa.Array:
        out = []
        for m, *box in zip(_decoded(g), *(c.to_pylist() for c in (x0, y0, x1, y1))):
            polys = ([r for r in (k.clip_box(r, *box) for r in rings) if len(r) > 3 and abs(k.ring_area(r)) > 0] for rings in m)
            out.append([rings for rings in polys if rings])
        return _encoded(out)

    out = pairs.withColumn("l_geom", _once(cut)(F.col(f"l_{geometry}"), *[F.col(f"r_{c}") for c in spatial.BOX])).filter("l_geom.polys is not null")
    keep = [c for c in layer.columns if c not in ("scene_id", geometry)]
    return out.select(F.col("r_scene_id").alias("scene_id"), *[F.col(f"l_{c}").alias(c) for c in keep], F.col("l_geom").alias(geometry))


def subtracted(cover: DataFrame, buildings: DataFrame, min_area: float = SLIVER_M2) -> DataFrame:
    """Cover polygons (scene_id, id, geom) minus all buildings of their scene. A shape is a group with the buildings that
    touch it, and copies of a shape are cut once; slivers of at most `min_area` go, in scenes with buildings only."""
    built = buildings.select("scene_id").distinct().withColumn("__built", F.lit(True))
    large = F.coalesce(geo.area(F.col("geom")) > min_area, F.lit(False))
    shapes = saved(cover.select("scene_id", "geom").distinct().join(built, "scene_id").withColumn("__large", large), "cover-shapes")
    a, b = with_bounds(shapes.filter("__large").select("scene_id", "geom")), with_bounds(saved(buildings.select("scene_id", "geom").distinct(), "building-shapes"))
    pairs = spatial.box_pairs(a, b)
    near = pairs.groupBy(F.col("l_scene_id").alias("scene_id"), F.col("l_geom").alias("geom")).agg(F.collect_list("r_geom").alias("near"))

    @F.arrow_udf(geo.GEOM)
    def minus(g: pa.Array, near: pa.Array) -> pa.Array:
        # buildings apart from each other make fewer slabs than their union
        return _encoded([[[t] for t in k.difference(x, many)] for x, many in zip(_decoded(g), _lists(near))])

    left = spatial.spread(near, "scene_id", "geom").select("scene_id", "geom", _once(minus)(F.col("geom"), F.col("near")).alias("__left")).withColumn("__gone", ~F.coalesce(geo.area(F.col("__left")) > min_area, F.lit(False)))
    slivers = shapes.filter("not __large").select("scene_id", "geom", F.lit(None).cast(geo.GEOM).alias("__left"), F.lit(True).alias("__gone"))
    # most shapes are as they were; the others are hashed by part, so that the rows are not sorted by geometry
    changed = left.unionByName(slivers).hint("shuffle_hash")
    rows = cover.join(changed, ["scene_id", "geom"], "left").filter("not coalesce(__gone, false)")
    return rows.withColumn("geom", F.coalesce("__left", "geom")).select(*cover.columns)


def union_areas(polygons: DataFrame, keys: tuple[str, ...] = ("scene_id",), layer: str = "layer", side: float = 64.0) -> DataFrame:
    """By key: area_a, area_b and area_ab of the unions of layers a and b, by square cells, so that neither a scene nor
    a stripe of it is one task's."""
    polygons = polygons.select(*keys, layer, "geom").distinct()  # copies add nothing to a union
    b = geo.bounds(F.col("geom"))
    across = lambda lo, hi: F.explode(F.sequence(F.floor(b[lo] / side), F.floor(b[hi] / side)))
    dealt = polygons.select(*keys, layer, "geom", across("x0", "x1").alias("__i")).select("*", across("y0", "y1").alias("__j"))
    types = dict(polygons.dtypes)

    def run(table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        lo, low = (t.column(c)[0].as_py() * side for c in ("__i", "__j"))
        sides: dict[str, list] = {"a": [], "b": []}
        geoms = t.column("geom").chunk(0) if t.column("geom").num_chunks else pa.array([], t.schema.field("geom").type)
        for name, m in zip(t.column(layer).to_pylist(), _decoded(geoms)):
            cut = [[r for r in (k.clip_box(r, lo, low, lo + side, low + side) for r in rings) if len(r) > 3] for rings in m]
            if any(cut):
                sides[name].append([c for c in cut if c])
        areas = [k.area_of(k.overlay(sides["a"], sides["b"], f)) for f in (lambda p, q: p, lambda p, q: q, lambda p, q: p and q)]
        return pa.table({c: t.column(c).slice(0, 1) for c in keys} | {n: pa.array([v], pa.float64()) for n, v in zip(("area_a", "area_b", "area_ab"), areas)})

    schema = ", ".join(f"{c} {types[c]}" for c in keys)
    parts = spatial.spread(dealt, *keys, "__i", "__j").groupBy(*keys, "__i", "__j").applyInArrow(run, f"{schema}, area_a double, area_b double, area_ab double")
    return parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("area_a", "area_b", "area_ab")])


def rasterized(patches: DataFrame, polygons: DataFrame, size: int) -> DataFrame:
    """Patches (scene_id, id, box in pixels) with mask: a byte for each pixel, 1 where its centre lies in a polygon."""
    pairs = spatial.box_pairs(patches.select("scene_id", "id", *spatial.BOX), with_bounds(polygons.select("scene_id", "geom")))
    near = pairs.groupBy(F.col("l_scene_id").alias("scene_id"), F.col("l_id").alias("id")).agg(F.collect_list("r_geom").alias("near"))

    @F.arrow_udf("binary")
    def draw(x0: pa.Array, y0: pa.Array, near: pa.Array) -> pa.Array:
        out = []
        for x, y, many in zip(x0.to_pylist(), y0.to_pylist(), _lists(near)):
            rings = [[r - [x, y] for r in p] for m in many for p in m]
            out.append(k.rasterize(rings, size, size).astype(np.uint8).tobytes())
        return pa.array(out, pa.binary())

    return patches.join(near, ["scene_id", "id"], "left").withColumn("mask", draw(F.col("x0").cast("double"), F.col("y0").cast("double"), F.col("near"))).drop("near")


def footprints(probability: DataFrame, keys: list[str], threshold: float = 0.5, row: str = "prow", col: str = "pcol") -> DataFrame:
    """Positive regions of a probability raster as polygons in pixel corners; mean_p is the mean over the whole raster,
    the confidence that all its footprints get."""
    from geoloom.operators import segments

    marked = probability.withColumn("__on", (F.col("p") >= threshold).cast("int"))
    traced = segments.polygons(marked, keys, "__on", row, col)
    polys = F.array(F.transform("rings", lambda r: F.transform(r, lambda v: geo.point(v["x"], v["y"]))))
    mean = probability.groupBy(*keys).agg(F.avg("p").alias("mean_p"))
    return traced.join(mean, keys).select(*keys, "piece", F.struct(F.lit("Polygon").alias("kind"), polys.alias("polys")).alias("geom"), "mean_p")


def large_buildings(df: DataFrame, min_area: float = MIN_BUILDING_M2, column: str = "geom") -> DataFrame:
    """Footprints that are there and have at least `min_area`, before they are regularised."""
    return df.filter(geo.is_present(F.col(column)) & (geo.area(F.col(column)) >= min_area))
