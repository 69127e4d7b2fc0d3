"""Every registered query with SQL gives DuckDB's rows over the smallest tables."""

import duckdb
import pytest

from sylvagraph.code_queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows(spark, duck, name):
    got, expected = QUERIES[name](spark, SF).toPandas(), duck.execute(SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns)
    a, b = (x[columns].astype(str).sort_values(columns).reset_index(drop=True) for x in (got, expected))
    assert a.equals(b)
