"""The queries that SQL can express, against DuckDB on the same tables."""

import duckdb
import pandas as pd
import pytest

from tidemark.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_query_is_its_sql(spark, name):
    base = duckdb.connect()
    for table in ("documents", "pages", "embeddings"):
        base.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = base.sql(queries.oracle_sql()[name]).fetchdf()
    got = queries.queries()[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want) > 0
    text = lambda frame: frame.map(lambda x: None if pd.isna(x) else str(x) if not isinstance(x, float) or x % 1 else str(int(x)))
    rows = lambda frame: sorted(map(str, text(frame[sorted(got.columns)]).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)
