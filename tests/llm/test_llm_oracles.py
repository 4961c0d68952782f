"""Every training-data query with an oracle gives DuckDB's rows on the driver tables."""

import os

import duckdb
import pytest

from geoloom.llm import queries as llm

TABLES = "documents pages benchmark labels conversations".split()


def rows(names, data):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in at) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_matches_its_oracle(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    got = llm.queries()[name](spark, sf_dir)
    want = con.execute(llm.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())


def test_url_rules_are_mined_on_the_given_tables(spark, sf_dir):
    assert llm.queries()["op6_url_filter"](spark, sf_dir).filter("by = 'mined'").count() > 0
