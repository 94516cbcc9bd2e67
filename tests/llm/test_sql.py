"""The SQL of the queries of this subpackage gives their rows."""

import duckdb
import pytest
from rasterlake.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(name, spark, sf):
    duck = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "embeddings"):
        duck.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    wanted = duck.sql(queries.SQL[name])
    assert sorted(df.columns) == sorted(wanted.columns)
    columns = sorted(df.columns)
    rows = lambda names, got: sorted(str([r[names.index(c)] for c in columns]) for r in got)
    assert rows(df.columns, df.collect()) == rows(wanted.columns, wanted.fetchall())
