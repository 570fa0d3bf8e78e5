"""The corpus queries that SQL can express, against DuckDB."""

import duckdb
import pandas as pd
import pytest

from textloom.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "labels", "conversations"):
        con.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    got, want = registry.queries()[name](spark, SF).toPandas(), con.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) > 0
    plain = lambda v: "null" if pd.isna(v) else repr(float(v)) if isinstance(v, (int, float)) else str(v)
    rows = lambda df: sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None))
    assert rows(got) == rows(want)
