"""Every registered query against its DuckDB oracle SQL at sf0.001."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from ticketflow.plans.oracle import SQL
from ticketflow.plans.queries import REGISTRY
from tools.check_oracle import TABLES, digest

SF = "/root/testdata/sf0.001"
NAMES = sorted(REGISTRY)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle_and_is_registered():
    assert set(NAMES) == set(SQL)
    assert set(NAMES) <= set(E.queries()) and set(SQL) <= set(E.oracle_sql())


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data missing")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = REGISTRY[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    # the driver makes a view of each statement
    con.execute(f"CREATE OR REPLACE VIEW oracle_query AS {SQL[name]}")
    cur = con.execute("SELECT * FROM oracle_query")
    cols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(df.columns) == sorted(cols)
    assert len(rows) == len(drows)
    assert digest(df.columns, rows)[0] == digest(cols, drows)[0]


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
