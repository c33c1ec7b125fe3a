"""Queries against their SQL in DuckDB, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from ledgerline.llm import queries

TABLES = "documents embeddings pages benchmark".split()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name]).df()
    got = queries.QUERIES[name](spark, sf).toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns) and len(want) == len(got) and len(got)
    a, b = (x[columns].astype(object).where(x[columns].notna(), None).astype(str).replace(r"\.0$", "", regex=True).sort_values(columns, ignore_index=True) for x in (want, got))
    pd.testing.assert_frame_equal(a, b)
