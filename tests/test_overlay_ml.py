import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from geoloom.functions import geometry as geo
from geoloom.functions import pixels as px
from geoloom.operators import ml, overlay, segments, spatial, tiles


def layer(spark, rings, extra=()):
    rows = [(1, i, {"kind": "Polygon", "polys": [[[{"x": float(x), "y": float(y)} for x, y in r]]]}, *e) for (i, r), e in zip(enumerate(rings), extra or [()] * len(rings))]
    return spark.createDataFrame(rows, "scene_id long, id long, geom " + geo.GEOM + (", class string, subtype string" if extra else ""))


SQUARE = [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]
TRIANGLE = [(0, 0), (10, 0), (0, 10), (0, 0)]


def test_triangle_covers_half_of_a_square(spark):
    a, b = layer(spark, [SQUARE]), layer(spark, [TRIANGLE, [(20, 20), (21, 20), (21, 21), (20, 20)]], [("house", None), ("barn", None)])
    got = spatial.overlap_labels(overlay.with_bounds(a), overlay.with_bounds(b), polygons=True).first()
    assert got.overlap == pytest.approx(0.5) and got.label == 1 and got.ref_class == "house"
    counts = spatial.match_objects(overlay.with_bounds(a), overlay.with_bounds(b), polygons=True).first()
    assert (counts.tp_pred, counts.tp_gt, counts.fn) == (1, 1, 1)


def test_boxes_that_meet_while_their_polygons_do_not(spark):
    other = [(10, 10), (10, 6), (6, 10), (10, 10)]
    a, b = overlay.with_bounds(layer(spark, [TRIANGLE])), overlay.with_bounds(layer(spark, [other]))
    assert spatial.match_objects(a, b).first().tp_pred == 1 and spatial.match_objects(a, b, polygons=True).first().tp_pred == 0


def test_cover_minus_buildings_drops_slivers(spark):
    cover = layer(spark, [SQUARE, [(50, 50), (52, 50), (52, 52), (50, 50)]])
    out = {r.id: r.a for r in overlay.subtracted(cover, layer(spark, [TRIANGLE])).select("id", geo.area(F.col("geom")).alias("a")).collect()}
    assert out == {0: pytest.approx(50)}  # the second is under five square metres in a scene with buildings
    none = layer(spark, [TRIANGLE]).withColumn("scene_id", F.lit(2).cast("long"))
    assert overlay.subtracted(cover, none).count() == 2


def test_union_areas_of_polygons(spark):
    rows = layer(spark, [SQUARE, TRIANGLE, [(60, 0), (70, 0), (70, 10), (60, 10), (60, 0)]]).withColumn("layer", F.when(F.col("id") == 1, "b").otherwise("a"))
    got = overlay.union_areas(rows).first()
    assert (got.area_a, got.area_b, got.area_ab) == (pytest.approx(200), pytest.approx(50), pytest.approx(50))


def test_bow_tie_is_repaired_and_snapping_squares(spark):
    tie = layer(spark, [[(0, 0), (10, 10), (10, 0), (0, 10), (0, 0)]])
    assert overlay.repaired(tie).select(geo.area(F.col("geom")).alias("a")).first().a == pytest.approx(50)
    got = overlay.ortho_snapped(layer(spark, [[(0, 0), (10, 0.4), (10, 8), (0, 8), (0, 0)], [(0, 0), (1, 0), (1, 1), (0, 0)]])).collect()
    assert [r.id for r in got] == [0]


def test_footprints_and_patch_masks_agree(spark):
    grid = [(1, r, c, 1.0 if 2 <= r < 5 and 1 <= c < 7 else 0.1) for r in range(8) for c in range(8)]
    prob = spark.createDataFrame(grid, "scene_id long, prow long, pcol long, p double")
    shapes = overlay.footprints(prob, ["scene_id"])
    assert shapes.select(geo.area(F.col("geom")).alias("a"), "mean_p").first()[:] == (18.0, pytest.approx((18 + 4.6) / 64))
    patch = spark.createDataFrame([(1, 0, 0, 0, 8, 8)], "scene_id long, id long, x0 long, y0 long, x1 long, y1 long")
    mask = np.frombuffer(overlay.rasterized(patch, shapes, 8).first()["mask"], np.uint8).reshape(8, 8)
    assert mask.sum() == 18 and mask[2:5, 1:7].all()


def test_inference_takes_any_function(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 2.0)], "id int, x double")
    assert [r.p for r in ml.infer(df, lambda pdf: pd.Series(pdf["x"] * 2)).collect()] == [0.0, 4.0]


def test_detections_keep_two_classes(spark):
    corners = [{"x": 0.0, "y": 0.0}, {"x": 4.0, "y": 0.0}, {"x": 4.0, "y": 2.0}, {"x": 0.0, "y": 2.0}]
    raw = spark.createDataFrame([(10, 0.5, corners, 100, 10), (3, 0.9, corners, 0, 0), (9, 0.2, corners, 0, 0)], "class_no int, conf double, corners array<struct<x:double,y:double>>, col_off int, row_off int")
    one, zero = F.lit(1.0), F.lit(0.0)
    got = ml.detections(raw, [one, zero, zero, zero, -one, zero]).collect()
    assert [(r.cls, r.confidence, r.lon, r.lat) for r in got] == [("car", 50, 102.0, -11.0)]


def test_superpixel_frame_and_texture(spark):
    rows = [(1, r, c, 10.0, 200.0 if c > 3 else 20.0, 10.0, True) for r in range(8) for c in range(8)]
    df = spark.createDataFrame(rows, "tile_id long, prow long, pcol long, r double, g double, b double, valid boolean")
    seg = segments.superpixels(df, ["tile_id"], n_segments=4)
    assert seg.columns[-1] == "segment_id" and "segment_id" not in df.columns
    assert segments.texture_and_outline(seg, ["tile_id"]).filter("solidity > 0.9").count() >= 2
    assert segments.polygons(seg, ["tile_id"]).count() >= 2


def test_owned_pixels_leave_no_overlap(spark):
    s = spark.createDataFrame([(1, 40, 30)], "scene_id long, width_px long, height_px long")
    t = tiles.tiles(s, 16, 4).withColumn("prow", F.explode(F.sequence(F.lit(0).cast("long"), F.col("height") - 1))).withColumn("pcol", F.explode(F.sequence(F.lit(0).cast("long"), F.col("width") - 1)))
    kept = t.filter(tiles.owned(F.col("prow"), F.col("pcol"), F.col("row_off"), F.col("col_off"), 4))
    assert kept.select((F.col("row_off") + F.col("prow")).alias("r"), (F.col("col_off") + F.col("pcol")).alias("c")).distinct().count() == kept.count() == 1200


def test_augmentation_is_a_bijection(spark):
    df = spark.range(16).select((F.col("id") % 4).alias("c"), F.floor(F.col("id") / 4).alias("r")).crossJoin(spark.range(4).withColumnRenamed("id", "turn"))
    r, c = px.augmented(F.col("r"), F.col("c"), 4, F.lit(True), F.col("turn") > 1, F.col("turn"))
    assert df.select("turn", r.alias("r"), c.alias("c")).distinct().count() == 64


def boxes_of(spark, n, seed, copies):
    """n boxes of two scenes, each `copies` times with ids of its own, with class and subtype."""
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        x, y, w, h = (int(v) for v in (*r.integers(0, 40, 2), *r.integers(3, 12, 2)))
        rows += [(i % 2, i + n * c, x, y, x + w, y + h, f"c{(i + c) % 3}", None if c else f"s{i % 2}") for c in range(copies)]
    return rows, spark.createDataFrame(rows, "scene_id long, id long, x0 long, y0 long, x1 long, y1 long, class string, subtype string")


def overlap_of(a, b, dx=0, dy=0):
    return max(0, min(a[4], b[4] - dx) - max(a[2], b[2] - dx)) * max(0, min(a[5], b[5] - dy) - max(a[3], b[3] - dy)) * (a[0] == b[0])


@pytest.fixture
def pairs_made(monkeypatch):
    """How many pairs each box join made."""
    made, plain = [], spatial.box_pairs

    def counting(*a, **b):
        out = plain(*a, **b)
        made.append(out.count())
        return out

    monkeypatch.setattr(spatial, "box_pairs", counting)
    return made


def test_shifts_of_copies_are_paired_once(spark, pairs_made):
    (a, left), (b, right) = boxes_of(spark, 12, 1, 5), boxes_of(spark, 15, 2, 4)
    shifts = spark.createDataFrame([(3 * i + j, j * 2, i) for i in range(3) for j in range(3)], "shift long, dx long, dy long")
    want = {s: sum(overlap_of(p, q, d, e) for p in a for q in b) for s, d, e in ((r.shift, r.dx, r.dy) for r in shifts.collect())}
    assert {r.shift: r.shared for r in ml.shifted_overlap(left, right, shifts).collect()} == {s: v for s, v in want.items() if v}
    assert pairs_made.pop() <= 12 * 15  # not 20 times as many


def test_labels_of_shifted_copies(spark, pairs_made):
    (a, left), (b, right) = boxes_of(spark, 12, 3, 5), boxes_of(spark, 15, 4, 4)
    shifts = spark.createDataFrame([(3 * i + j, j * 2, i) for i in range(3) for j in range(3)], "shift long, dx long, dy long")
    want = {}
    for s, d, e in ((r.shift, r.dx, r.dy) for r in shifts.collect()):
        for p in a:
            f = sum(overlap_of(p, q, d, e) for q in b) / ((p[4] - p[2]) * (p[5] - p[3]))
            if f > 0:
                want[s, p[1]] = (f, 1 if f >= 0.5 else 0 if f <= 0.05 else -1)
    labels = ml.shifted_labels(left, right, shifts)
    assert {(r.shift, r.id): (pytest.approx(r.overlap), r.label) for r in labels.collect()} == want
    assert pairs_made.pop() <= 12 * 15
    counts = sorted(map(tuple, ml.shift_counts(left, ml.shifted_boxes(left, right, shifts), shifts).collect()))
    of = lambda s, v: sum(k[0] == s and x[1] == v for k, x in want.items())
    assert counts == [(s, len(a) - of(s, -1), of(s, 1)) for s in range(9)] == sorted(map(tuple, ml.shift_counts(left, labels, shifts).collect()))


@pytest.mark.parametrize("polygons", [False, True])
def test_labels_of_copies_by_the_least_reference(spark, pairs_made, polygons):
    (a, left), (b, right) = boxes_of(spark, 12, 5, 5), boxes_of(spark, 15, 6, 4)
    left, right = (x.withColumn("geom", geo.box(*[F.col(c) for c in spatial.BOX])) for x in (left, right))
    got = {r.id: r for r in spatial.overlap_labels(left.drop("class", "subtype"), right, polygons=polygons).collect()}
    assert len(got) == len(a)
    for p in a:
        shares = [(overlap_of(p, q), -q[1], q[6], q[7]) for q in b if overlap_of(p, q)]
        assert got[p[1]].overlap == pytest.approx(sum(s[0] for s in shares) / ((p[4] - p[2]) * (p[5] - p[3])))
        assert (got[p[1]].ref_class, got[p[1]].ref_subtype) == (max(shares)[2:] if got[p[1]].label == 1 else (None, None))
    assert pairs_made.pop() <= 12 * 15


def test_copies_of_cover_are_cut_once(spark, pairs_made):
    cover, built = layer(spark, [SQUARE] * 6 + [[(0, 0), (2, 0), (2, 2), (0, 2), (0, 0)], [(50, 50), (60, 50), (60, 60), (50, 60), (50, 50)]]), layer(spark, [[(5, -1), (12, -1), (12, 12), (5, 12), (5, -1)]] * 7 + [TRIANGLE])
    got = {r.id: r.a for r in overlay.subtracted(cover, built).select("id", geo.area(F.col("geom")).alias("a")).collect()}
    assert got == {i: pytest.approx(12.5) for i in range(6)} | {7: 100.0}
    assert pairs_made.pop() <= 2 * 2


def test_touching_copies_are_compared_once(spark, pairs_made):
    ell = [(0, 0), (8, 0), (8, 4), (4, 4), (4, 8), (0, 8), (0, 0)]
    a, b = layer(spark, [ell] * 5 + [TRIANGLE]), layer(spark, [[(x + 6, y + 2) for x, y in ell]] * 3 + [[(x + 4, y + 4) for x, y in ell]] + [[(x + 4.5, y + 4.5) for x, y in ell]])
    got = {(r.a, r.b): r.shared for r in overlay.touching(a, b).collect()}
    assert got == {(i, j): 4.0 if j < 3 else 0.0 for i in range(5) for j in range(4)} | {(5, j): pytest.approx(2.0) for j in range(3)} | {(5, 3): pytest.approx(2.0), (5, 4): pytest.approx(0.5)}
    assert pairs_made.pop() <= 2 * 3


def test_copies_add_nothing_to_union_areas(spark):
    rows = layer(spark, [SQUARE] * 40 + [TRIANGLE] * 40).withColumn("layer", F.when(F.col("id") < 40, "a").otherwise("b"))
    got = overlay.union_areas(rows)
    assert "HashAggregate(keys=[scene_id" in got._jdf.queryExecution().executedPlan().toString().split("FlatMapGroupsInArrow")[1]  # copies go before the cells
    assert tuple(got.first()[1:]) == (pytest.approx(100), pytest.approx(50), pytest.approx(50))
