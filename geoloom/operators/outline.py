"""Directions of outlines."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from geoloom.functions import kernels
from geoloom.operators.overlay import _decoded


def principal_angle(geom: Column) -> Column:
    """Degrees of the longer side of the least rotated rectangle around the first polygon's outer ring."""

    @F.arrow_udf("double")
    def run(g: pa.Array) -> pa.Array:
        return pa.array([kernels.principal_angle(m[0][0][:-1]) if m else None for m in _decoded(g)], pa.float64())

    return run(geom)
