"""The segment stage as one plan: tiles to superpixels, their features, polygons, labels by overlap and training use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.functions import geometry as geo
from geoloom.operators import overlay, schema, segments, spatial
from geoloom.session import saved


def segment_layer(tiles: DataFrame, keys: list[str], n_segments: int = 200, radius: int = 3) -> tuple[DataFrame, DataFrame]:
    """(features, pieces) of tile rows (scene_id, tile_idx, width, arrays r, g, b, valid): one row of features for each
    segment, and the polygons of its pieces in tile pixels. Segments are numbered over the tiles of their scene."""
    pixels = segments.masked_pixels(tiles, keys, radius)
    marked = saved(segments.superpixels(pixels, keys, n_segments).filter("segment_id > 0"), "segment-pixels")  # read four times
    by = [*keys, "segment_id"]
    parts = [segments.color_features(marked, by), segments.shape_features(marked, by), segments.texture_and_outline(marked, keys)]
    features = parts[0]
    for p in parts[1:]:
        features = features.join(p, by)
    traced = segments.polygons(marked, keys)
    polys = F.array(F.transform("rings", lambda r: F.transform(r, lambda v: geo.point(v["x"], v["y"]))))
    pieces = traced.withColumn("geom", F.struct(F.lit("Polygon").alias("kind"), polys.alias("polys"))).drop("rings")
    number = schema.global_segment_id(F.col("tile_idx"), F.col("segment_id"))
    return segments.with_compactness(features).withColumn("segment_id", number), pieces.withColumn("segment_id", number)


def labelled(features: DataFrame, pieces: DataFrame, refs: DataFrame) -> DataFrame:
    """Features with label, overlap, ref_class and ref_subtype from references (scene_id, id, box, geom, class, subtype) in
    the same coordinates, and use_for_train. Of a segment's pieces the last one counts."""
    shaped = overlay.with_bounds(pieces.withColumn("id", F.col("segment_id") * 1000 + F.col("piece")))
    tagged = spatial.overlap_labels(shaped, overlay.with_bounds(refs), polygons=True).select("scene_id", F.struct("scene_id", "segment_id").alias("segment"), "piece", "overlap", "label", "ref_class", "ref_subtype")
    last = spatial.last_piece(tagged.drop("scene_id"), "segment").select("segment.scene_id", "segment.segment_id", "overlap", "label", "ref_class", "ref_subtype")
    out = schema.joined_features(schema.drop_present(features, "overlap", "label", "ref_class", "ref_subtype"), last, ["scene_id", "segment_id"])
    return out.withColumn("use_for_train", spatial.usable_for_training())
