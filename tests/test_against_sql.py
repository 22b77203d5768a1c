"""Every registered query against its SQL twin on the smallest data folder."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from ledgerline.bindings import BASE
from ledgerline.registry import all_queries, all_sql
from tools.check import same_kind, table

SF = os.environ.get("LEDGERLINE_TEST_SF", "/root/testdata/sf0.001")
QUERIES, SQL = all_queries(), all_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_every_statement_has_a_query():
    assert not SQL.keys() - QUERIES.keys()
    assert not QUERIES.keys() - SQL.keys()


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and {"date", "revenue", "total_revenue", "revenue_change"} == set(rows[0].asDict())


@pytest.mark.parametrize("key", sorted(SQL))
def test_same_result(spark, duck, key):
    df = QUERIES[key](spark, SF)
    found = table(df.columns, df.collect())
    cursor = duck.execute(SQL[key])
    names, kinds = [d[0] for d in cursor.description], [str(d[1]) for d in cursor.description]
    assert found == table(names, cursor.fetchall())
    by_name = dict(zip(names, kinds))
    assert all(same_kind(f.dataType.simpleString(), by_name[f.name]) for f in df.schema)
