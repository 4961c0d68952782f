"""Geometry as Column expressions.

A geometry is `struct<kind: string, polys: array<array<array<struct<x: double, y: double>>>>>`: polygons of rings of
vertices, rings closed, the first ring the outer one. Areas and perimeters count holes; everything here is native.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GEOM = "struct<kind:string,polys:array<array<array<struct<x:double,y:double>>>>>"
#: Transverse Mercator of WGS 84 (fixed values).
A_AXIS, FLAT, K0, FALSE_EAST = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0
#: Metres in a degree, as the scene areas use them (fixed values).
M_PER_LON, M_PER_LAT = 111320.0, 110540.0


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    ring = F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1), point(x0, y0))
    return F.struct(F.lit("Polygon").alias("kind"), F.array(F.array(ring)).alias("polys"))


def _edges(ring: Column) -> Column:
    """(a, b) for each edge of a closed ring."""
    return F.transform(F.sequence(F.lit(0), F.size(ring) - 2), lambda i: F.struct(F.get(ring, i).alias("a"), F.get(ring, i + 1).alias("b")))


def ring_area2(ring: Column) -> Column:
    """Twice the signed area."""
    return F.when(F.size(ring) < 3, 0.0).otherwise(F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]))


def ring_length(ring: Column) -> Column:
    return F.when(F.size(ring) < 2, 0.0).otherwise(F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + F.hypot(e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"])))


def area(geom: Column) -> Column:
    def polygon(rings: Column) -> Column:
        sizes = F.transform(rings, lambda r: F.abs(ring_area2(r)) / 2)
        return F.get(sizes, F.lit(0)) * 2 - F.aggregate(sizes, F.lit(0.0), lambda s, a: s + a)  # outer minus the holes

    return F.aggregate(F.transform(geom["polys"], polygon), F.lit(0.0), lambda s, a: s + a)


def length(geom: Column) -> Column:
    return F.aggregate(F.transform(F.flatten(geom["polys"]), ring_length), F.lit(0.0), lambda s, a: s + a)


def map_vertices(geom: Column, move) -> Column:
    polys = F.transform(geom["polys"], lambda p: F.transform(p, lambda r: F.transform(r, move)))
    return F.when(geom.isNotNull(), F.struct(geom["kind"].alias("kind"), polys.alias("polys")))


def translate(geom: Column, dx: Column, dy: Column) -> Column:
    return map_vertices(geom, lambda v: point(v["x"] + dx, v["y"] + dy))


def bounds(geom: Column) -> Column:
    v = F.flatten(F.flatten(geom["polys"]))
    xs, ys = F.transform(v, lambda p: p["x"]), F.transform(v, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def rotate(geom: Column, degrees: Column, cx: Column, cy: Column) -> Column:
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    return map_vertices(geom, lambda v: point(cx + (v["x"] - cx) * c - (v["y"] - cy) * s, cy + (v["x"] - cx) * s + (v["y"] - cy) * c))


def ring_centroid(ring: Column) -> Column:
    """Area-weighted centroid of a ring."""
    first = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def add(s: Column, e: Column) -> Column:
        w = e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]
        return F.struct((s["a"] + w).alias("a"), (s["x"] + (e["a"]["x"] + e["b"]["x"]) * w).alias("x"), (s["y"] + (e["a"]["y"] + e["b"]["y"]) * w).alias("y"))

    return F.aggregate(_edges(ring), first, add, lambda s: point(s["x"] / (3 * s["a"]), s["y"] / (3 * s["a"])))


def snap_ring(ring: Column) -> Column:
    """Every edge made horizontal or vertical, whichever is dominant, walking once around; closed."""
    open_ = F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(1)))
    rest = F.concat(F.slice(open_, F.lit(2), F.greatest(F.size(open_) - 1, F.lit(0))), F.slice(open_, 1, 1))

    def step(done: Column, v: Column) -> Column:
        last = F.element_at(done, -1)
        flat = F.abs(v["x"] - last["x"]) > F.abs(v["y"] - last["y"])
        return F.concat(done, F.array(F.when(flat, point(v["x"], last["y"])).otherwise(point(last["x"], v["y"]))))

    walked = F.aggregate(rest, F.slice(open_, 1, 1), step)
    closed = F.when(F.element_at(walked, -1) == F.get(walked, F.lit(0)), walked).otherwise(F.concat(walked, F.slice(walked, 1, 1)))
    return F.when(F.size(ring) < 4, ring).otherwise(closed)


def affine(col: Column, row: Column, t: list[Column]) -> tuple[Column, Column]:
    """(x, y) of a pixel under the six-number transform x = a*col + b*row + c, y = d*col + e*row + f."""
    a, b, c, d, e, f = t
    return a * col + b * row + c, d * col + e * row + f


def window_bounds(col_off: Column, row_off: Column, width: Column, height: Column, t: list[Column]) -> Column:
    xa, ya = affine(col_off, row_off, t)
    xb, yb = affine(col_off + width, row_off + height, t)
    return F.struct(F.least(xa, xb).alias("x0"), F.least(ya, yb).alias("y0"), F.greatest(xa, xb).alias("x1"), F.greatest(ya, yb).alias("y1"))


def utm_zone(lon: Column) -> Column:
    return (F.floor((lon + 180) / 6) + 1).cast("int")


def utm_epsg(lon: Column) -> Column:
    """Northern hemisphere only, without the Norwegian exceptions."""
    return utm_zone(lon) + 32600


def bound(value: Column, body) -> Column:
    """`body` of `value`, which is evaluated once however often it stands in the body."""
    return F.transform(F.array(value), body)[0]


def utm_forward_point(lon: Column, lat: Column, zone: Column) -> Column:
    """Easting and northing as a vertex, by the third-order Krueger series."""
    n = FLAT / (2 - FLAT)
    radius = A_AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * n**0.5 / (1 + n)

    def plane(g: Column) -> Column:
        east, north = g["eta"], g["xi"]
        for j, a in enumerate(alpha, 1):
            east = east + a * F.cos(2 * j * g["xi"]) * F.sinh(2 * j * g["eta"])
            north = north + a * F.sin(2 * j * g["xi"]) * F.cosh(2 * j * g["eta"])
        return point(FALSE_EAST + K0 * radius * east, K0 * radius * north)

    sphere = bound(F.sin(F.radians(lat)), lambda s: F.struct(F.sinh(F.atanh(s) - e * F.atanh(e * s)).alias("t"), F.radians(lon - (zone * 6 - 183)).alias("dl")))
    return bound(bound(sphere, lambda g: F.struct(F.atan(g["t"] / F.cos(g["dl"])).alias("xi"), F.atanh(F.sin(g["dl"]) / F.sqrt(1 + g["t"] * g["t"])).alias("eta"))), plane)


def utm_forward(lon: Column, lat: Column, zone: Column) -> tuple[Column, Column]:
    p = utm_forward_point(lon, lat, zone)
    return p["x"], p["y"]


def utm_inverse_point(east: Column, north: Column, zone: Column) -> Column:
    """Longitude and latitude as a vertex: the inverse series, once corrected by what its forward image misses (under
    1 um)."""
    again = bound(_inverse_series(east, north, zone), lambda p: utm_forward_point(p["x"], p["y"], zone))
    return bound(again, lambda q: _inverse_series(2 * east - q["x"], 2 * north - q["y"], zone))


def utm_inverse(east: Column, north: Column, zone: Column) -> tuple[Column, Column]:
    p = utm_inverse_point(east, north, zone)
    return p["x"], p["y"]


def _inverse_series(east: Column, north: Column, zone: Column) -> Column:
    n = FLAT / (2 - FLAT)
    radius = A_AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)

    def sphere(g: Column) -> Column:
        xp, ep = g["xi"], g["eta"]
        for j, b in enumerate(beta, 1):
            xp = xp - b * F.sin(2 * j * g["xi"]) * F.cosh(2 * j * g["eta"])
            ep = ep - b * F.cos(2 * j * g["xi"]) * F.sinh(2 * j * g["eta"])
        return F.struct(xp.alias("x"), ep.alias("e"))

    def place(g: Column) -> Column:
        def lat(chi: Column) -> Column:
            out = chi
            for j, d in enumerate(delta, 1):
                out = out + d * F.sin(2 * j * chi)
            return point((zone * 6 - 183) + F.degrees(F.atan(F.sinh(g["e"]) / F.cos(g["x"]))), F.degrees(out))

        return bound(F.asin(F.sin(g["x"]) / F.cosh(g["e"])), lat)

    start = F.struct((north / (K0 * radius)).alias("xi"), ((east - FALSE_EAST) / (K0 * radius)).alias("eta"))
    return bound(bound(start, sphere), place)


def scene_area_km2(width_deg: Column, height_deg: Column, lat: Column) -> Column:
    """Area of a footprint by metres in a degree at its latitude."""
    return width_deg * M_PER_LON * F.cos(F.radians(lat)) * height_deg * M_PER_LAT / 1e6


def box_overlap(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Shared area of two axis-aligned boxes."""
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))


def boxes_touch(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Closed intersection: a shared edge or corner counts."""
    return (a["x0"] <= b["x1"]) & (b["x0"] <= a["x1"]) & (a["y0"] <= b["y1"]) & (b["y0"] <= a["y1"])


def corners_centre(corners: Column) -> Column:
    """Mean of an array of corners."""
    n = F.size(corners)
    return point(F.aggregate(corners, F.lit(0.0), lambda s, p: s + p["x"]) / n, F.aggregate(corners, F.lit(0.0), lambda s, p: s + p["y"]) / n)


def is_polygonal(geom: Column) -> Column:
    return geom["kind"].isin("Polygon", "MultiPolygon")


def is_present(geom: Column) -> Column:
    return geom.isNotNull() & (F.size(geom["polys"]) > 0)
