"""Geo views over the driver tables, as SQL that Spark and DuckDB both run.

`{table}` stands for a driver table. `E(i)` is element i (0-based) of `embedding` as a double.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_PIXEL = """
select tile_id, scene_id, pos, cast(floor(pos / 8) as bigint) prow, cast(pos % 8 as bigint) pcol,
       cast(least(255e0, greatest(0e0, floor((e0 + 0.6e0) * 200e0))) as double) r,
       cast(least(255e0, greatest(0e0, floor((e1 + 0.6e0) * 200e0))) as double) g,
       cast(least(255e0, greatest(0e0, floor((e2 + 0.6e0) * 200e0))) as double) b,
       e0 > -0.3e0 valid
from (select vec_id tile_id, cast(label as bigint) scene_id, pos, E(pos) e0, E((pos+21)%64) e1, E((pos+42)%64) e2
      from {embeddings} cross join range(64) as rr(pos)) z"""

VIEWS = {
    "v_scene": """
select cast(n_nationkey as bigint) scene_id, case when n_nationkey < 10 then 'A' else 'B' end city,
       case when n_nationkey in (0,3,11,13) then 'holdout' else 'train' end split,
       cast(2000 + n_nationkey * 137 as bigint) width_px, cast(1800 + n_nationkey * 211 as bigint) height_px,
       (case when n_nationkey < 10 then 76.8e0 else 71.3e0 end) + 0.01e0 * n_nationkey lon0,
       (case when n_nationkey < 10 then 43.2e0 else 51.1e0 end) lat1, 5e-7 res_deg
from {nation} where n_nationkey < 20""",
    "v_pixel": _PIXEL,
    "v_pred": """
select p_partkey id, p_partkey % 20 scene_id, (p_partkey * 7919) % 1000 x0, (p_partkey * 104729) % 1000 y0,
       (p_partkey * 7919) % 1000 + 5 + p_size % 20 x1, (p_partkey * 104729) % 1000 + 5 + (p_partkey * 31) % 20 y1
from {part}""",
    "v_gt": """
select o_orderkey id, o_orderkey % 20 scene_id, (o_orderkey * 6007) % 1000 x0, (o_orderkey * 86028) % 1000 y0,
       (o_orderkey * 6007) % 1000 + 6 + o_custkey % 17 x1, (o_orderkey * 86028) % 1000 + 6 + (o_orderkey * 13) % 19 y1,
       case o_orderkey % 6 when 0 then 'apartments' when 1 then ' School ' when 2 then 'nan'
            when 3 then 'unknown_kind' when 4 then 'Garage' else null end class,
       case o_orderkey % 5 when 0 then 'residential' when 1 then 'MEDICAL' when 2 then 'military'
            when 3 then null else 'odd' end subtype,
       case o_orderkey % 4 when 0 then 5e0 when 1 then 1e0 when 2 then cast('NaN' as double) else null end num_floors
from {orders}""",
    "v_det": """
select event_id id, user_id % 20 scene_id, ((event_id * 7919) % 100003) / 100e0 x, ((event_id * 104729) % 100003) / 100e0 y,
       cast(floor(least(value, 99e0)) as bigint) conf
from {events}""",
    "v_prob": f"""
select scene_id, tile_id, (tile_id % 10) * 6 + prow arow, (cast(floor(tile_id / 10) as bigint) % 10) * 6 + pcol acol, r / 255e0 p
from ({_PIXEL}) px""",
    "v_bin": "select doc_id, quality pred, toxic truth from {labels}",
}


def _elements(sql: str, shift: int) -> str:
    out = re.sub(r"E\(pos\)", f"cast(embedding[pos{'+1' if shift else ''}] as double)", sql)
    return re.sub(r"E\(\((pos\+\d+)\)%64\)", lambda m: f"cast(embedding[cast(({m[1]})%64 as int){'+1' if shift else ''}] as double)", out)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = _elements(VIEWS[name], 0).replace("range(64) as rr(pos)", "(select cast(id as int) pos from range(64)) rr")
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", sql))}
    return spark.sql(sql, **tables)


def tile_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """v_pixel before it is taken apart: a row for each tile, with arrays r, g, b and valid row by row."""
    e = lambda shift: f"cast(embedding[cast((p + {shift}) % 64 as int)] as double)"
    band = lambda shift: f"transform(sequence(0, 63), p -> cast(least(255e0, greatest(0e0, floor(({e(shift)} + 0.6e0) * 200e0))) as double))"
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return table.selectExpr("vec_id tile_id", "cast(label as bigint) scene_id", "8 width", f"{band(0)} r", f"{band(21)} g", f"{band(42)} b", f"transform(sequence(0, 63), p -> {e(0)} > -0.3e0) valid")


def duck(name: str) -> str:
    """The view's text for DuckDB, where the driver tables have their own names."""
    return re.sub(r"\{(\w+)\}", r"\1", _elements(VIEWS[name], 1))


def with_views(*names: str) -> str:
    return "with recursive " + ", ".join(f"{n} as materialized ({duck(n)})" for n in names)
