"""Every query with an oracle gives DuckDB's rows on the driver tables."""

import os

import duckdb
import pytest

from geoloom import queries as core

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def rows(names, data):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(float(r[i]) if isinstance(r[i], (int, float)) and not isinstance(r[i], bool) else r[i] for i in at) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_query_matches_its_oracle(spark, duck, sf_dir, name):
    got = core.queries()[name](spark, sf_dir)
    want = duck.execute(core.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(core.queries()) - set(core.oracle_sql()) - {"q34_rf"}))
def test_query_without_oracle_runs(spark, sf_dir, name):
    assert core.queries()[name](spark, sf_dir).count() > 0


@pytest.mark.parametrize("name", ["q01_object_match", "q02_overlap_label", "q03_best_overlap_subclass", "q19_shift_grid"])
def test_spatial_joins_are_no_nested_loops(spark, sf_dir, name):
    plan = core.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan.replace("BroadcastNestedLoopJoin BuildRight, Cross", "") and "CartesianProduct" not in plan
