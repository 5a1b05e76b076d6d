"""Every query of the catalog against its DuckDB SQL on the smallest tables."""

import datetime as dt
import glob
import os

import duckdb
import pytest

from quillwork import catalog


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for path in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if hasattr(v, "is_signed"):
        return round(float(v), 6)
    return v


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_same_rows(spark, duck, data, name):
    mine = catalog.QUERIES[name](spark, data)
    other = duck.sql(catalog.ORACLE[name])
    assert sorted(mine.columns) == sorted(other.columns)
    assert rows(mine.columns, [tuple(r) for r in mine.collect()]) == rows(other.columns, other.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_runs(spark, data, name):
    assert catalog.QUERIES[name](spark, data).count() >= 0
