"""GeoJSON layers to the geometry struct and back (RFC 7946: longitude, latitude, WGS 84)."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoloom.functions import geometry as geo
from geoloom.operators import overlay
from geoloom.sources import store

_FEATURE = "features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"


def read(spark: SparkSession, path: str, properties: dict[str, str]) -> DataFrame:
    """One row for each feature: the named properties (name: type) and geom; other geometry than points and polygons
    is null. A collection is one document, so a file is one task: large layers belong in Parquet."""
    doc = spark.read.schema(_FEATURE).option("multiLine", True).json(path)
    f = doc.select(F.explode("features").alias("f"))
    kind, raw = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    ring = "array<array<array<double>>>"
    points = F.from_json(raw, "array<double>")
    polys = F.when(kind == "Polygon", F.array(F.from_json(raw, ring))).when(kind == "MultiPolygon", F.from_json(raw, f"array<{ring}>"))
    shaped = F.transform(polys, lambda p: F.transform(p, lambda r: F.transform(r, lambda v: geo.point(v[0], v[1]))))
    geom = F.when(polys.isNotNull(), F.struct(kind.alias("kind"), shaped.alias("polys"))).when(kind == "Point", F.struct(kind.alias("kind"), F.array(F.array(F.array(geo.point(points[0], points[1])))).alias("polys")))
    return f.select(*[F.col("f.properties")[n].cast(t).alias(n) for n, t in properties.items()], geom.alias("geom"))


def geometry_json(geom: Column) -> Column:
    polys = F.transform(geom["polys"], lambda p: F.transform(p, lambda r: F.transform(r, lambda v: F.array(v["x"], v["y"]))))
    coordinates = F.when(geom["kind"] == "Point", F.to_json(polys[0][0][0])).when(geom["kind"] == "Polygon", F.to_json(polys[0])).otherwise(F.to_json(polys))
    return F.when(geom.isNull(), F.lit("null")).otherwise(F.concat(F.lit('{"type":"'), geom["kind"], F.lit('","coordinates":'), coordinates, F.lit("}")))


def features(df: DataFrame, geometry: str = "geom") -> DataFrame:
    """One JSON feature a row, in the column value."""
    props = F.to_json(F.struct(*[c for c in df.columns if c != geometry]), {"ignoreNullFields": "false"})
    return df.select(F.concat(F.lit('{"type":"Feature","properties":'), props, F.lit(',"geometry":'), geometry_json(F.col(geometry)), F.lit("}")).alias("value"))


def write(df: DataFrame, path: str, geometry: str = "geom", epsg: int = 4326) -> None:
    """A FeatureCollection file in place of any at `path`, in WGS 84: `epsg` is what the layer is in (4326, or a northern
    UTM zone, 326xx, from which it is projected back). Features are made in parallel; the document is joined row by row,
    so the driver never holds the layer. Any storage that Spark writes will do."""
    spark = df.sparkSession
    if epsg != 4326:
        df = df.withColumn(geometry, overlay.to_wgs84(F.col(geometry), F.lit(epsg - 32600)))
    parts = f"{path}.{uuid.uuid4().hex}"
    features(df, geometry).write.text(parts)

    def document() -> Iterator[str]:
        yield '{"type":"FeatureCollection","features":['
        comma = ""
        for row in spark.read.schema("value string").text(parts).toLocalIterator(prefetchPartitions=True):
            yield comma + row.value
            comma = ",\n"
        yield "]}\n"

    store.write_text(spark, path, document())
    store.delete(spark, parts)


def write_by_class(df: DataFrame, folder: str, prefix: str, column: str = "class", geometry: str = "geom", epsg: int = 4326) -> list[str]:
    """<prefix>_<class>.geojson for each class; null classes are left out. Returns the paths."""
    paths = []
    for (name,) in df.filter(F.col(column).isNotNull()).select(column).distinct().orderBy(column).collect():  # a handful of classes
        paths.append(f"{folder}/{prefix}_{name}.geojson")
        write(df.filter(F.col(column) == name), paths[-1], geometry, epsg)
    return paths


def valid_position(lon: Column, lat: Column) -> Column:
    return lon.between(-180, 180) & lat.between(-90, 90)


def ring_is_closed(ring: Column) -> Column:
    return (F.size(ring) >= 4) & (F.element_at(ring, 1) == F.element_at(ring, -1))


def outer_is_counter_clockwise(ring: Column) -> Column:
    return geo.ring_area2(ring) > 0


def empty(spark: SparkSession, schema: str | T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)
