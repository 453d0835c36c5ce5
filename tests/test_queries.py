"""Every query with SQL gives what DuckDB gives on the same tables; the others give rows."""

import datetime
import decimal
import math

import duckdb
import pytest

from maskwright import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 9)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, duck, sf, name):
    df = queries.QUERIES[name](spark, sf)
    names = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    if name not in queries.SQL:
        assert rows
        return
    result = duck.sql(queries.SQL[name])
    assert sorted(result.columns) == names
    place = [result.columns.index(c) for c in names]
    assert rows == sorted((tuple(plain(r[i]) for i in place) for r in result.fetchall()), key=repr)


def test_entry_has_a_query_for_each_sql():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
