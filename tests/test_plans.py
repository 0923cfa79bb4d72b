"""Every registered query against its SQL on the smallest tables, and the entry point's contract."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark import plans

SF = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.10g}")
    return v


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    df = plans.queries()[name](spark, SF)
    rel = duck.sql(plans.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    types = dict(zip(rel.columns, map(str, rel.types), strict=True))
    assert {c: TYPES[t] for c, t in df.dtypes} == types
    at = [rel.columns.index(c) for c in cols]
    got = ordered(tuple(plain(r[c]) for c in cols) for r in df.collect())
    assert got and got == ordered(tuple(plain(r[k]) for k in at) for r in rel.fetchall())


def test_queries_without_sql(spark):
    found = plans.queries()
    rest = set(found) - set(plans.oracle_sql())
    assert rest == {"commit_metadata", "workshop_load"}
    for name in rest:
        assert found[name](spark, SF).count() > 0


def test_entry(spark):
    assert plans.FLAGSHIP in plans.queries()
    out = entry.entry(spark)
    assert out.columns[0] == "topic" and out.count() == 4
    assert set(entry.oracle_sql()) <= set(entry.queries())
