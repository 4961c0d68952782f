import os
import sqlite3
import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from geoloom.functions import geometry as geo
from geoloom.operators import metrics, rules, schema, segments, spatial, tiles
from geoloom.sources import geojson, geopackage, raster, tables


def test_tile_and_patch_grids(spark):
    s = spark.createDataFrame([(1, 2000, 1000)], "scene_id long, width_px long, height_px long")
    got = tiles.tiles(s).orderBy("tile_idx").collect()
    assert len(got) == 6 and (got[2].width, got[5].height) == (208, 104)
    p = spark.createDataFrame([(1, 500, 300), (2, 200, 400)], "scene_id long, width_px long, height_px long")
    assert {(r.col, r.row) for r in tiles.patches(p).collect()} == {(0, 0), (192, 0), (244, 0), (0, 44), (192, 44), (244, 44)}


def test_tiles_cover_every_pixel(spark):
    s = spark.createDataFrame([(1, 333, 217)], "scene_id long, width_px long, height_px long")
    seen = np.zeros((217, 333), bool)
    for t in tiles.tiles(s, 64, 16).collect():
        seen[t.row_off : t.row_off + t.height, t.col_off : t.col_off + t.width] = True
    assert seen.all()


def test_suppression_keeps_first_and_third(spark):
    pts = spark.createDataFrame([(1, 1, 0.0, 0.0, 90), (1, 2, 1.0, 0.0, 80), (1, 3, 3.0, 0.0, 70), (1, 4, 4.9, 0.0, 60)], "scene_id long, id long, x double, y double, conf long")
    assert sorted(r.id for r in spatial.suppress_points(pts, 2.0).collect()) == [1, 3]
    assert sorted(r.id for r in spatial.suppress_points(pts, 2.0, tile=1).collect()) == [1, 3]


def test_suppression_is_independent_and_maximal(spark):
    rng = np.random.default_rng(5)
    rows = [(i % 2, i, float(x), float(y), int(c)) for i, (x, y, c) in enumerate(zip(rng.random(300) * 40, rng.random(300) * 40, rng.integers(0, 99, 300)))]
    df = spark.createDataFrame(rows, "scene_id long, id long, x double, y double, conf long")
    kept = {r.id for r in spatial.suppress_points(df, 3.0).collect()}
    rounds = {r.id for r in spatial.suppress_points(df, 3.0, tile=1).collect()}  # many edges, several rounds
    assert kept == rounds
    near = lambda a, b: a[0] == b[0] and (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2 < 9
    assert not any(near(a, b) for a in rows for b in rows if a[1] < b[1] and {a[1], b[1]} <= kept)
    assert all(r[1] in kept or any(near(r, q) for q in rows if q[1] in kept) for r in rows)


def test_box_pairs_equal_the_nested_loop_whatever_the_sizes(spark):
    rng = np.random.default_rng(1)

    def boxes(n):
        xy, wh = rng.integers(-200, 800, (n, 2)), 2 ** rng.integers(0, 11, (n, 2))
        return [(int(i % 2), i, int(a), int(b), int(a + w), int(b + h)) for i, ((a, b), (w, h)) in enumerate(zip(xy, wh))]

    a, b = boxes(120), boxes(150)
    ddl = "scene_id long, id long, x0 long, y0 long, x1 long, y1 long"
    got = [(r.l_id, r.r_id) for r in spatial.box_pairs(spark.createDataFrame(a, ddl), spark.createDataFrame(b, ddl)).collect()]
    want = [(p[1], q[1]) for p in a for q in b if p[0] == q[0] and p[2] <= q[4] and q[2] <= p[4] and p[3] <= q[5] and q[3] <= p[5]]
    assert sorted(got) == sorted(want)


def test_building_rules(spark):
    rows = [("residential", None, 260.0, None), ("residential", float("nan"), 260.0, None), ("residential", 5.0, 10.0, None), ("residential", 1.0, 900.0, None), ("military", None, 10.0, "unknown_kind"), (None, None, 250.0, "None"), (None, None, 250.1, " School ")]
    df = spark.createDataFrame(rows, "subtype string, floors double, area double, class string")
    got = [r.c for r in df.select(rules.building_class(F.col("class"), F.col("subtype"), F.col("floors"), F.col("area")).alias("c")).collect()]
    assert got == ["apartment_block", "apartment_block", "apartment_block", "house", "civic", "house", "school"]
    assert len(rules.CLASSES) == 59 and len(set(rules.CLASSES.values())) == 11


def test_both_covers_at_exactly_half(spark):
    df = spark.createDataFrame([(1, 0.5, 0.5), (2, 0.49, 0.2)], "id long, frac_vegetation double, frac_soil double")
    assert sorted((r.id, r["class"], r.confidence) for r in rules.land_cover(df).collect()) == [(1, "bare_soil", 50), (1, "vegetation", 50)]


def test_empty_predictions_and_aggregate(spark):
    ddl = "scene_id long, id long, x0 long, y0 long, x1 long, y1 long"
    counts = spatial.match_objects(spark.createDataFrame([], ddl), spark.createDataFrame([(1, 1, 0, 0, 5, 5)], ddl))
    got = {r.scene_id: r for r in metrics.with_aggregate(counts).collect()}
    assert (got["1"].fn, got["1"].fp, got["AGGREGATE"].f1) == (1, 0, 0)


def test_schema_completion(spark):
    df = spark.createDataFrame([("b", None, 2), ("a", "x", 1)], "extra string, id string, k int")
    got = schema.completed(df, "src", ["k"])
    assert got.columns == ["id", "class", "confidence", "source", "date", "change_flag", "extra", "k"]
    assert [r.id for r in got.orderBy("k").collect()] == ["f_000000", "f_000001"]
    assert spark.range(1).select(schema.finite(F.lit(float("inf"))).alias("x")).first().x == 0


def test_training_use_of_unlabelled_segments(spark):
    df = spark.createDataFrame([(None, 0.1), (-1, 0.1), (1, 0.6), (0, 0.5)], "label int, frac_vegetation double").withColumn("frac_shadow", F.lit(0.0)).withColumn("frac_soil", F.lit(0.0))
    assert [r.u for r in df.select(spatial.usable_for_training().alias("u")).collect()] == [True, False, False, True]


def test_shape_of_a_bar(spark):
    px = spark.createDataFrame([(1, r, c) for r in range(2) for c in range(8)], "seg long, prow long, pcol long")
    got = segments.shape_features(px, ["seg"]).first()
    assert got.area_px == 16 and got.extent == 1 and got.major_axis_len > 3.5 * got.minor_axis_len


def test_geojson_and_geopackage_round_trip(spark, tmp_path):
    poly = {"kind": "Polygon", "polys": [[[{"x": 0.0, "y": 0.0}, {"x": 2.0, "y": 0.0}, {"x": 2.0, "y": 1.5}, {"x": 0.0, "y": 0.0}]]]}
    dot = {"kind": "Point", "polys": [[[{"x": 7.25, "y": 8.0}]]]}
    df = spark.createDataFrame([("a", 1, poly), ('q"uote', None, dot)], f"name string, n int, geom {geo.GEOM}")
    path = str(tmp_path / "layer.geojson")
    geojson.write(df, path)
    back = {r.name: r for r in geojson.read(spark, path, {"name": "string", "n": "int"}).collect()}
    assert back["a"].geom.asDict(True) == poly and back['q"uote'].geom.asDict(True) == dot and back["a"].n == 1 and back['q"uote'].n is None
    gpkg = str(tmp_path / "out.gpkg")
    assert geopackage.write_layer(df, gpkg, "things") == 2 and geopackage.write_layer(df, gpkg, "things") == 2
    blob = sqlite3.connect(gpkg).execute("select geom from things where name = 'a'").fetchone()[0]
    assert blob[:2] == b"GP" and struct.unpack_from("<BI", blob, 8) == (1, 3)
    named = df.withColumn("class", F.col("name"))
    assert [os.path.basename(p) for p in geojson.write_by_class(named.filter("n is not null"), str(tmp_path), "building")] == ["building_a.geojson"]


def test_missing_tables_are_empty(spark, tmp_path):
    assert tables.read_or_empty(spark, str(tmp_path / "none"), "a int").count() == 0


def tiff(path, px, compress):
    h, w, n = px.shape
    strips = [px[r : r + 7].tobytes() for r in range(0, h, 7)]
    strips = [zlib.compress(s) for s in strips] if compress else strips
    scale, tie = struct.pack("<3d", 0.5, 0.25, 0), struct.pack("<6d", 0, 0, 0, 76.0, 43.0, 0)
    at = 8 + 2 + 12 * 11 + 4
    offs, body = [], b""
    for s in strips:
        offs.append(at + len(body))
        body += s
    extra = {k: at + len(body) + sum(map(len, v)) for k, v in ((1, []), (2, [scale]), (3, [scale, tie]), (4, [scale, tie, struct.pack(f"<{len(offs)}I", *offs)]))}
    tail = scale + tie + struct.pack(f"<{len(offs)}I", *offs) + struct.pack(f"<{len(strips)}I", *map(len, strips)) + struct.pack(f"<{n}H", *[8] * n)
    bits = extra[4] + 4 * len(strips)
    tags = [(256, 3, 1, w), (257, 3, 1, h), (258, 3, n, bits), (259, 3, 1, 8 if compress else 1), (273, 4, len(offs), extra[3]), (277, 3, 1, n), (278, 3, 1, 7), (279, 4, len(offs), extra[4]), (284, 3, 1, 1), (33550, 12, 3, extra[1]), (33922, 12, 6, extra[2])]
    with open(path, "wb") as f:
        f.write(b"II" + struct.pack("<HI", 42, 8) + struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags) + struct.pack("<I", 0) + body + tail)


def test_raster_tiles(spark, tmp_path):
    px = np.random.default_rng(2).integers(0, 255, (40, 30, 4)).astype(np.uint8)
    for compress in (False, True):
        path = str(tmp_path / f"{compress}.tif")
        tiff(path, px, compress)
        paths = spark.createDataFrame([(path,)], "path string")
        meta = raster.metadata(paths).first()
        assert (meta.width_px, meta.height_px, meta.bands, meta.transform) == (30, 40, 4, [0.5, 0.0, 76.0, 0.0, -0.25, 43.0])
        got = np.zeros((40, 30, 3), np.uint8)
        for t in raster.read_tiles(paths, 16, 4).collect():
            got[t.row_off : t.row_off + t.height, t.col_off : t.col_off + t.width] = np.frombuffer(t.rgb, np.uint8).reshape(t.height, t.width, 3)
        assert (got == px[..., :3]).all()
    cells = raster.pixels(raster.read_tiles(paths, 64, 0)).filter("prow = 3 and pcol = 5").first()
    assert (cells.r, cells.g, cells.b) == tuple(px[3, 5, :3]) and cells.valid == bool(px[3, 5, 3] > 0)


def pack_lzw(data):
    """Codes of 9 to 12 bits, most significant first, with the early change of width that the format asks for."""
    table, codes, word = {bytes([i]): i for i in range(256)}, [(256, 9)], b""
    width = lambda more=2: 12 if len(table) + more >= 2048 else 11 if len(table) + more >= 1024 else 10 if len(table) + more >= 512 else 9
    for i in range(len(data)):
        more = data[i : i + 1]
        if word + more in table:
            word += more
            continue
        codes.append((table[word], width()))
        table[word + more] = len(table) + 2
        word = more
        if len(table) + 2 >= 4094:
            codes.append((256, 12))
            table = {bytes([k]): k for k in range(256)}
    if word:
        codes.append((table[word], width()))
    codes.append((257, width(3)))
    bits = "".join(format(c, f"0{w}b") for c, w in codes)
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


def test_packed_strips_are_unpacked():
    rng = np.random.default_rng(4)
    for data in (b"", b"a", b"abababababab" * 50, bytes(rng.integers(0, 4, 9000).astype(np.uint8)), bytes(rng.integers(0, 256, 20000).astype(np.uint8))):
        assert raster.unpack_lzw(pack_lzw(data)) == data
    assert raster.unpack_bits(bytes([2, 65, 66, 67, 253, 90, 128, 0, 68])) == b"ABCZZZZD"


def test_planes_big_files_and_geo_keys(spark, tmp_path):
    px = np.random.default_rng(5).integers(0, 255, (9, 7, 3)).astype(np.uint8)
    one = str(tmp_path / "one.tif")
    with open(one, "wb") as f:
        f.write(raster.geotiff(px, [0.5, 0.0, 76.0, 0.0, -0.25, 43.0], 32643, rows_per_strip=4))
    got = raster.Tiff(one)
    assert (got.window(1, 2, 5, 6) == px[2:8, 1:6]).all() and got.epsg == 32643 and got.transform == [0.5, 0.0, 76.0, 0.0, -0.25, 43.0]
    planes = [px[..., k].tobytes() for k in range(3)]
    at = 16 + 8 + 20 * 9 + 8
    offsets, body = [at + 63 * k for k in range(3)], b"".join(planes)
    outside = at + len(body)
    tags = [(256, 4, 1, 7), (257, 4, 1, 9), (258, 3, 3, struct.unpack("<Q", struct.pack("<4H", 8, 8, 8, 0))[0]), (259, 3, 1, 1), (273, 16, 3, outside), (277, 3, 1, 3), (278, 4, 1, 9), (279, 16, 3, outside + 24), (284, 3, 1, 2)]
    big = str(tmp_path / "big.tif")
    with open(big, "wb") as f:
        f.write(b"II" + struct.pack("<HHHQQ", 43, 8, 0, 16, len(tags)) + b"".join(struct.pack("<HHQQ", *t) for t in tags) + struct.pack("<Q", 0) + body + struct.pack("<3Q", *offsets) + struct.pack("<3Q", 63, 63, 63))
    assert (raster.Tiff(big).window(0, 0, 7, 9) == px).all()
    meta = {r.path: r for r in raster.metadata(spark.createDataFrame([(one,), (big,)], "path string")).collect()}
    assert (meta[one].epsg, meta[one].x0, meta[one].y1, meta[one].utm_epsg, meta[big].epsg) == (32643, 76.0, 43.0, None, None)


def test_boxes_in_degrees_and_huge_boxes_are_dealt_by_their_size(spark):
    rng = np.random.default_rng(7)
    small = [(1, i, float(x), float(y), float(x) + 2e-5, float(y) + 2e-5) for i, (x, y) in enumerate(rng.random((400, 2)) * 0.01 + 50)]
    ddl = "scene_id long, id long, x0 double, y0 double, x1 double, y1 double"
    a = spark.createDataFrame(small, ddl)
    levels = sorted({r.v for r in a.select(spatial._level().alias("v")).collect()})
    assert max(r["count"] for r in spatial._dealt(a, levels).groupBy("__level", "__cx", "__cy").count().collect()) < 12
    b = spark.createDataFrame([(1, 900, -1e9, -1e9, 1e9, 1e9), (1, 901, 50.005, 50.005, 50.005, 50.005)], ddl)
    got = sorted((r.l_id, r.r_id) for r in spatial.box_pairs(a, b).collect())
    assert got == sorted((p[1], q) for p in small for q, *box in ((900, -1e9, -1e9, 1e9, 1e9), (901, 50.005, 50.005, 50.005, 50.005)) if p[2] <= box[2] and box[0] <= p[4] and p[3] <= box[3] and box[1] <= p[5])
    levels = sorted({r.v for r in a.unionByName(b).select(spatial._level().alias("v")).filter("v is not null").collect()})
    assert spatial._dealt(b, levels).count() < 20


def test_training_log_has_one_header(tmp_path):
    from geoloom import logs

    for k in range(3):
        logs.append_row(str(tmp_path / "log.csv"), {"epoch": k, "loss": k / 2})
    assert (tmp_path / "log.csv").read_text().split() == ["epoch,loss", "0,0.0", "1,0.5", "2,1.0"]


def test_a_task_reads_more_scenes_than_it_may_hold_open(tmp_path):
    import os
    import resource

    import pandas as pd
    import pytest

    names = [str(tmp_path / f"{i}.tif") for i in range(200)]
    for name in names:
        with open(name, "wb") as f:
            f.write(raster.geotiff(np.full((2, 2, 4), 7, np.uint8), [0.5, 0.0, 76.0, 0.0, -0.25, 43.0]))
    runs = []

    class Paths:
        def select(self, *columns):
            return self

        def mapInPandas(self, run, schema):
            runs.append(run)
            raise LookupError

    with pytest.raises(LookupError):
        raster.metadata(Paths())
    soft, hard = resource.getrlimit(resource.RLIMIT_NOFILE)
    resource.setrlimit(resource.RLIMIT_NOFILE, (max(map(int, os.listdir("/proc/self/fd"))) + 50, hard))
    try:
        kept = next(runs[0](iter([pd.DataFrame({"path": names})])))
    finally:
        resource.setrlimit(resource.RLIMIT_NOFILE, (soft, hard))
    assert list(kept["width_px"]) == [2] * 200


def test_mosaic_does_not_hang_on_the_order_of_addition(spark):
    draw = np.random.default_rng(3)
    values = draw.integers(0, 256, 1024) // 2
    values[:200] += (51 * 8 * 301 - values.sum()) // 200
    values[200] += 51 * 8 * 301 - values.sum()
    rows = [(k, float(v) / 255) for k in range(20) for v in draw.permutation(values)]
    p = spark.createDataFrame(rows, "k long, p double")
    exact = 51 * 8 * 301 / (255 * 1024)  # a tie: 470312.5 millionths
    for parts in (1, 7):
        assert {r.p for r in tiles.mosaic(p.repartition(parts), ["k"]).collect()} == {exact}
    odd = spark.createDataFrame([(1, 9.0), (1, 2.0), (2, float("nan")), (3, None), (4, 0.25), (4, None)], "k long, p double")
    got = {r.k: r.p for r in tiles.mosaic(odd, ["k"]).collect()}
    assert (got[1], got[3], got[4]) == (5.5, None, 0.25) and np.isnan(got[2])
