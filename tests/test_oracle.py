"""Every registered query against its SQL twin on DuckDB (exact value hash)."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
from check_oracle import TABLES, digest, type_mismatches  # noqa: E402

import __spark_entry__ as E  # noqa: E402
from riskprice.plans import queries as Q  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle_and_is_registered():
    assert set(Q.queries()) == set(Q.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    rel = con.sql(E.oracle_sql()[name])
    s_rows, d_rows = [tuple(r) for r in df.collect()], rel.fetchall()
    assert len(s_rows) == len(d_rows)
    assert sorted(df.columns) == sorted(rel.columns)
    assert type_mismatches(df, rel) == {}
    assert digest(df.columns, s_rows)[0] == digest(rel.columns, d_rows)[0]


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and len(df.columns) == 48
