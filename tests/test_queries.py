"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import math

import duckdb
import pytest

from wavemill.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_rows(spark, duck, small, name):
    got = catalogue.QUERIES[name](spark, small)
    columns = sorted(got.columns)
    want = duck.sql(catalogue.ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    a = sorted(([plain(x) for x in r] for r in got.select(*columns).collect()), key=repr)
    b = sorted(([plain(r[i]) for i in at] for r in want.fetchall()), key=repr)
    assert a == b
