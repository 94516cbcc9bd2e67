"""Every registered query with SQL gives the SQL's rows on the smallest tables."""

import math

import duckdb
import pytest
from rasterlake import swath_queries  # noqa: F401
from rasterlake.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(name, spark, sf, duck):
    df = QUERIES[name](spark, sf)
    wanted = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(wanted.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(wanted.columns, wanted.fetchall())
