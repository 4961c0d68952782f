"""Geo-imagery analytics on Spark: tiles, pixels, footprints, detections and scene metrics as DataFrames."""
