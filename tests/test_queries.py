"""Every query with SQL against DuckDB, on the small tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="tables are not here")


def rows(df: pd.DataFrame) -> list[tuple]:
    def text(v):
        if isinstance(v, float):
            return "nan" if v != v else repr(round(v, 6) + 0.0)
        return "null" if v is None or (pd.api.types.is_scalar(v) and pd.isna(v)) else str(v)

    return sorted(tuple(text(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(path).removesuffix('.parquet')} as select * from read_parquet('{path}')")
    return con


CORE = [n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline"]


@pytest.mark.parametrize("name", CORE)
def test_query_equals_sql(spark, db, name):
    got, want = entry.queries()[name](spark, DATA).toPandas(), db.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_bloom_has_no_false_negatives(spark):
    got = entry.queries()["bloom_membership"](spark, DATA)
    assert got.count() > 0
