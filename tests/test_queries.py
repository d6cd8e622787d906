"""Every query against its SQL twin, on the smallest tables."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from provmill.plans import record_queries  # noqa: F401
from provmill.plans.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def tables():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, tables, name):
    got = QUERIES[name](spark, DATA)
    want = tables.sql(ORACLE_SQL[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    place = [want.columns.index(c) for c in columns]
    assert Counter(tuple(str(r[c]) for c in columns) for r in got.collect()) == Counter(tuple(str(r[i]) for i in place) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
