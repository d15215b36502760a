"""Registered queries against their SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
ALL = list(entry.oracle_sql())


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in ("documents", "pages", "labels", "embeddings"):
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", ALL)
def test_query_equals_its_sql(spark, db, name):
    got = entry.queries()[name](spark, SF).toPandas()
    want = db.sql(entry.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and len(got) == len(want)
    got, want = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert ((got == want) | (got.isna() & want.isna())).all().all()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
