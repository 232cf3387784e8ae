"""Queries of the llm operators that SQL can express give the same rows as DuckDB."""

import duckdb
import pandas as pd
import pytest

from quirework.llm import entry


def normal(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind == "f":
            df[c] = df[c].round(6)
        df[c] = df[c].map(lambda v: None if v is None or v is pd.NA or v != v else int(v) if isinstance(v, float) and v == int(v) else v).astype(str)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(name, spark, sf):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got, want = normal(entry.queries()[name](spark, sf).toPandas()), normal(con.sql(entry.oracle_sql()[name]).df())
    pd.testing.assert_frame_equal(got, want)
