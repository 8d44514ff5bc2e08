"""Every query that has SQL, against DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from thicket import queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


def text(v):
    if v is None or v is pd.NaT or v is pd.NA or v != v:
        return "null"
    if isinstance(v, (str, bool)) or type(v).__name__ in ("bool", "Timestamp"):
        return str(v)
    return f"{float(v):.5f}".replace("-0.00000", "0.00000")


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(text(v) for v in r) for r in df[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, db, name):
    assert rows(queries.QUERIES[name](spark, DATA).toPandas()) == rows(db.execute(queries.SQL[name]).df())
