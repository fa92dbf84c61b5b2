"""Every query with an oracle agrees with DuckDB on the smallest tables."""

import pytest
from oracle import compare, connect, normal

import __spark_entry__ as driver

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(driver.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    df = driver.queries()[name](spark, SF_DIR)
    got = normal(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(driver.oracle_sql()[name])
    want = normal([d[0] for d in cur.description], cur.fetchall())
    assert compare(got, want) is None


def test_entry(spark):
    assert driver.entry(spark).count() == 35


def test_every_oracle_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())
