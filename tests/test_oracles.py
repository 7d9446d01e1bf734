"""Every registered query with oracle SQL equals DuckDB's result on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from emberline.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def tidy(x):
    if isinstance(x, float) and math.isnan(x):
        return None
    return float(f"{x:.10g}") if isinstance(x, float) else float(x) if isinstance(x, int) and not isinstance(x, bool) else x


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.sql(ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda found: sorted((tuple(tidy(x) for x in r) for r in found), key=repr)
    assert rows(got.select(*columns).collect()) == rows(want.project(", ".join(f'"{c}"' for c in columns)).fetchall())


def test_every_query_is_checked():
    assert set(QUERIES) == set(ORACLES)
