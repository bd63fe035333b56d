"""Every query that SQL can express gives DuckDB's rows on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import cuelattice.plans.registry as registry

SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool | str):
        return value
    if isinstance(value, int | float):
        return round(float(value), 6)
    if isinstance(value, list | tuple):
        return tuple(map(plain, value))
    if hasattr(value, "as_tuple"):
        return round(float(value), 6)
    return str(value)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(name, spark, duck, sf_dir):
    ours = registry.queries()[name](spark, sf_dir)
    theirs = duck.sql(SQL[name])
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    order = [ours.columns.index(c) for c in columns]
    left = sorted((tuple(plain(r[k]) for k in order) for r in ours.collect()), key=repr)
    order = [theirs.columns.index(c) for c in columns]
    right = sorted((tuple(plain(r[k]) for k in order) for r in theirs.fetchall()), key=repr)
    assert left == right


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_others_run(name, spark, sf_dir):
    assert registry.queries()[name](spark, sf_dir).count() > 0
