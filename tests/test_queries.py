"""Every query with SQL gives what DuckDB gives on the smallest tables; the others give rows."""

import os

import duckdb
import pytest

from pairlens.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else f"{v + 0.0:.6g}"
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    if name in catalog.ORACLE:
        want = duck.sql(catalog.ORACLE[name])
        assert rows(df.columns, got) == rows(want.columns, want.fetchall())
    else:
        assert got
