"""Every registered query with SQL gives the rows that DuckDB gives for it."""

import os

import duckdb
import pandas as pd
import pytest

from vecloom.queries import registered

QUERIES = registered()


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for f in os.listdir(data):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{data}/{f}'")
    return c


def canonical(f: pd.DataFrame) -> pd.DataFrame:
    f = f[sorted(f.columns)].astype(str).replace({"nan": "None", "NaN": "None", "<NA>": "None", "-0.0": "0.0"})
    return f.sort_values(list(f.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in QUERIES.items() if sql))
def test_same_rows(spark, data, con, name):
    query, sql = QUERIES[name]
    got, want = canonical(query(spark, data).toPandas()), canonical(con.sql(sql).df())
    pd.testing.assert_frame_equal(got, want)


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in QUERIES.items() if not sql))
def test_runs(spark, data, name):
    assert QUERIES[name][0](spark, data).count() > 0
