"""Every registered query with oracle SQL must equal DuckDB's answer (the driver's correctness gate)."""

import importlib.util
import os

import duckdb
import pytest

from conftest import ROOT, SF001

spec = importlib.util.spec_from_file_location("check_oracle", os.path.join(ROOT, "scripts", "check_oracle.py"))
co = importlib.util.module_from_spec(spec)
spec.loader.exec_module(co)

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402

SQL = oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in co.TABLES:
        p = os.path.join(SF001, f"{t}.parquet")
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def test_every_query_has_a_name_and_most_have_sql():
    q = queries()
    assert set(SQL) <= set(q)
    assert len(SQL) >= 60


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    df = queries()[name](spark, SF001)
    cols, rows = df.columns, [tuple(r) for r in df.collect()]
    res = con.execute(SQL[name])
    ocols, orows = [d[0] for d in res.description], res.fetchall()
    assert sorted(cols) == sorted(ocols)
    assert len(rows) == len(orows)
    assert co._rows(cols, rows, 6) == co._rows(ocols, orows, 6)


def test_entry_smoke(spark):
    df = entry(spark)
    assert set(df.columns) == {"c_custkey", "c_acctbal", "c_mktsegment", "status", "pos"}
    assert df.count() >= 0
