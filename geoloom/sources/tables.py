"""CSV and Parquet tables with fallbacks, and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from geoloom.sources.store import exists


def read_csv(spark: SparkSession, schema: str, *paths: str) -> DataFrame:
    """The first of the paths that exists."""
    for p in paths:
        if exists(spark, p):
            return spark.read.schema(schema).csv(p, header=True)
    raise FileNotFoundError(", ".join(paths))


def read_or_empty(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A missing table is an empty one."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def read_buildings(spark: SparkSession, path: str, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Rows whose flat bounds meet the box; the filter reaches the Parquet statistics."""
    return spark.read.parquet(path).filter(f"x1 >= {x0} and x0 <= {x1} and y1 >= {y0} and y0 <= {y1}")


def write_csv(df: DataFrame, path: str) -> None:
    """One file with a header; for small reports."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_features(df: DataFrame, path: str, by: str = "scene_id") -> None:
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def write_once(df: DataFrame, path: str) -> None:
    """Nothing is done if the table is there already."""
    df.write.mode("ignore").parquet(path)
