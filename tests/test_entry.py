"""The driver contract: names agree, and the SQL gives what the plans give on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as contract
from terrazzo.plans import catalog

SF = "/root/testdata/sf0.001"


def _plain(value):
    return repr(value) if isinstance(value, float) else str(value)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


def test_every_sql_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_flagship(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, duck, name):
    df, sql = catalog.queries()[name](spark, SF), duck.sql(catalog.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(sql.columns)
    got = Counter(tuple(map(_plain, r)) for r in df.select(*cols).collect())
    want = Counter(tuple(map(_plain, r)) for r in sql.select(*[f'"{c}"' for c in cols]).fetchall())
    assert got == want
