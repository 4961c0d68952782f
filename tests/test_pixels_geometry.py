import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from geoloom.functions import geometry as geo
from geoloom.functions import kernels as k
from geoloom.functions import pixels as px

def rgb():
    return [F.col(c) for c in "rgb"]


def pixel(spark, r, g, b):
    df = spark.createDataFrame([(r, g, b, True)], "r double, g double, b double, valid boolean")
    fs = {"exg": px.excess_green, "v": px.color_invariance, "s": px.shadow_invariance, "cive": px.cive, "vig": px.vig}
    v = F.col("valid")
    cover = px.prioritized(px.vegetation(*rgb(), v), px.shadow(*rgb(), v), px.soil(*rgb(), v))
    return df.select(*[f(*rgb()).alias(n) for n, f in fs.items()], cover.alias("cover")).first()


@pytest.mark.parametrize(
    "bands, exg, cive, cover",
    [((0, 0, 0), 0, 18.78745, None), ((100, 100, 100), 0, 18.79245, None), ((60, 120, 60), 120, 18.58845, "vegetation"), ((160, 120, 80), 0, 18.79867, "soil")],
)
def test_golden_pixels(spark, bands, exg, cive, cover):
    got = pixel(spark, *map(float, bands))
    assert got.exg == exg and got.cive == pytest.approx(cive, abs=1e-5) and got.cover == cover
    assert got.s <= 0  # the shadow index never fires


def test_grey_shadow_index_and_hue(spark):
    assert pixel(spark, 100.0, 100.0, 100.0).s == pytest.approx(-1 / 3, abs=1e-4)
    h, s, v = px.hsv(*rgb())
    df = spark.createDataFrame([(255, 0, 0), (0, 255, 0), (0, 0, 255), (9, 9, 9)], "r int, g int, b int").select(h.alias("h"), s.alias("s"), v.alias("v"))
    assert [(round(x.h, 4), x.s) for x in df.collect()] == [(0.0, 1.0), (0.3333, 1.0), (0.6667, 1.0), (0.0, 0.0)]


def ring_df(spark, pts):
    return spark.createDataFrame([([{"x": float(x), "y": float(y)} for x, y in pts],)], "ring array<struct<x:double,y:double>>")


def test_snapped_ring(spark):
    got = ring_df(spark, [(0, 0), (4, 0.2), (4.1, 3), (0, 3.1), (0, 0)]).select(geo.snap_ring(F.col("ring")).alias("r")).first().r
    assert [(p.x, p.y) for p in got] == [(0, 0), (4, 0), (4, 3), (0, 3), (0, 0)]


def test_area_counts_holes_and_perimeter(spark):
    outer = [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]
    hole = [(1, 1), (1, 2), (2, 2), (2, 1), (1, 1)]
    row = {"kind": "Polygon", "polys": [[[{"x": float(x), "y": float(y)} for x, y in r] for r in (outer, hole)]]}
    df = spark.createDataFrame([(row,)], f"geom {geo.GEOM}")
    got = df.select(geo.area(F.col("geom")).alias("a"), geo.length(F.col("geom")).alias("l"), geo.bounds(F.col("geom")).alias("b")).first()
    assert got.a == 15 and got.l == 20 and tuple(got.b) == (0, 0, 4, 4)


def test_utm_round_trip_and_a_known_place(spark):
    df = spark.createDataFrame([(-79.387139, 43.642567), (76.9, 43.25), (71.4, 51.1)], "lon double, lat double").withColumn("zone", geo.utm_zone(F.col("lon")))
    e, n = geo.utm_forward(F.col("lon"), F.col("lat"), F.col("zone"))
    df = df.withColumn("e", e).withColumn("n", n)
    lon, lat = geo.utm_inverse(F.col("e"), F.col("n"), F.col("zone"))
    got = df.select("*", lon.alias("lon2"), lat.alias("lat2"), geo.utm_epsg(F.col("lon")).alias("epsg")).collect()
    assert (round(got[0].e), round(got[0].n)) == (630084, 4833439)
    assert [r.epsg for r in got[1:]] == [32643, 32642]
    assert all(abs(r.lon - r.lon2) < 1e-11 and abs(r.lat - r.lat2) < 1e-11 for r in got)


BOX = st.tuples(st.integers(0, 20), st.integers(0, 20), st.integers(1, 9), st.integers(1, 9)).map(lambda t: [np.array([[t[0], t[1]], [t[0] + t[2], t[1]], [t[0] + t[2], t[1] + t[3]], [t[0], t[1] + t[3]], [t[0], t[1]]], float)])


@settings(max_examples=60, deadline=None)
@given(BOX, BOX, st.floats(0, 90))
def test_union_and_intersection_areas_add_up(a, b, turn):
    b = [k.turned(r, turn, np.array([10.0, 10.0])) for r in b]
    both, either = k.intersection_area([a], [b]), k.area_of(k.union([[a], [b]]))
    assert both + either == pytest.approx(k.polygon_area(a) + k.polygon_area(b), abs=1e-6)
    assert k.area_of(k.difference([a], [[b]])) == pytest.approx(k.polygon_area(a) - both, abs=1e-6)
    if both > 1e-6:
        assert k.intersects(a, b)


@settings(max_examples=40, deadline=None)
@given(BOX)
def test_clipping_is_idempotent(a):
    once = k.clip_box(a[0], 3, 3, 15, 12)
    twice = k.clip_box(once, 3, 3, 15, 12) if len(once) else once
    assert (len(once) == 0 and len(twice) == 0) or abs(k.ring_area(once)) == pytest.approx(abs(k.ring_area(twice)))


def test_touching_boxes_intersect():
    a = [np.array([[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]], float)]
    assert k.intersects(a, [r + [1, 1] for r in a]) and not k.intersects(a, [r + [1.1, 0] for r in a])


def test_ortho_snap_squares_a_noisy_rectangle():
    ring = np.array([[0, 0], [5, 0.3], [10, 0], [10, 6], [0, 6], [0, 0]], float)
    (got,) = k.ortho_snap([k.turned(ring, 30, np.array([0.0, 0.0]))])
    back = k.turned(got[0], -k.principal_angle(got[0]), k.centroid(got[0]))
    steps = np.abs(np.diff(back, axis=0))
    assert (np.minimum(steps[:, 0], steps[:, 1]) < 1e-6).all() and k.polygon_area(got) == pytest.approx(60, abs=3)
    assert k.ortho_snap([ring / 10]) == []


def test_snapped_and_simplified_polygons_are_sound():
    rng = np.random.default_rng(8)
    for _ in range(300):
        angles = np.sort(rng.random(rng.integers(4, 14)) * 2 * np.pi)
        pts = np.stack((np.cos(angles), np.sin(angles)), 1) * (3 + 9 * rng.random((len(angles), 1)))
        ring = np.vstack((pts, pts[:1]))
        out = k.simplify_safely(ring, 1.5)
        assert k.crosses(ring) or not k.crosses(out)
        for p in k.ortho_snap([ring], 1.0):
            assert k.polygon_area(p) == pytest.approx(k.area_of(k.repaired([p])), rel=1e-6, abs=1e-9)


@pytest.mark.parametrize("ring, bad", [([(0, 0), (4, 0), (4, 3), (0, 3), (0, 0)], False), ([(0, 0), (4, 3), (4, 0), (0, 3), (0, 0)], True), ([(0, 0), (4, 0), (2, 0), (2, 3), (0, 0)], True), ([(0, 0), (4, 0), (0, 3), (0, 0)], False)])
def test_crossing_rings_are_seen(ring, bad):
    assert k.crosses(np.array(ring, float)) == bad


def test_trace_and_rasterize_are_inverse():
    rng = np.random.default_rng(3)
    label = rng.integers(0, 3, (9, 11))
    back = np.zeros_like(label)
    for value, _, rings in k.trace(label):
        back[k.rasterize([rings], *label.shape)] = value
    assert (back == label).all()


def test_morphology_texture_and_superpixels():
    mask = np.zeros((11, 11), bool)
    mask[2:9, 2:9] = True
    mask[0, 0] = True
    opened = k.opened(mask, 1)
    assert not opened[0, 0] and opened[3:8, 3:8].all() and (k.closed(mask, 1) | mask == k.closed(mask, 1)).all()
    flat = k.segment_texture(np.full((6, 6), 77.0), np.ones((6, 6), bool))
    assert flat["glcm_correlation"] == 1 and flat["glcm_asm"] == 1 and flat["solidity"] == 1
    assert sum(flat[f"lbp_h{i}"] for i in range(10)) == pytest.approx(1)
    image = np.zeros((16, 16, 3))
    image[:, 8:] = 200
    seg = k.superpixels(image, np.ones((16, 16), bool), 4, sigma=0)
    assert len(np.intersect1d(seg[:, :8], seg[:, 8:])) == 0 and seg.min() == 1


def test_intensity_and_votes_keep_invalid_pixels_out(spark):
    df = spark.createDataFrame([(60.0, 120.0, 60.0, False)], "r double, g double, b double, valid boolean")
    assert df.select(px.vegetation(*rgb(), F.col("valid")).alias("x")).first().x is False
    assert math.isclose(df.select(px.intensity(*rgb()).alias("x")).first().x, 80)


def test_convex_overlaps_equal_the_slabs():
    rng = np.random.default_rng(12)

    def convex():
        h = k.hull(rng.random((rng.integers(3, 9), 2)) * 10 + rng.integers(0, 6, 2))
        return [np.vstack((h, h[:1]))[:: rng.choice((1, -1))]]

    for _ in range(300):
        a, b = convex(), convex()
        want = k.area_of(k.overlay([[a]], [[b]], lambda p, q: p and q))
        assert k.intersection_area([a], [b]) == pytest.approx(want, rel=1e-7, abs=1e-9)
    square = [np.array([[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]], float)]
    assert k.intersection_area([square], [[square[0] + [4, 0]]]) == 0 and k.intersection_area([square], [square]) == 16
