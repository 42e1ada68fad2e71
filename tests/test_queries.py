"""Every registered query against its SQL counterpart, and the shape of the contract."""

import decimal
import os

import duckdb
import pytest

from __spark_entry__ import entry
from __spark_entry__ import oracle_sql as every_oracle
from __spark_entry__ import queries as every_query
from gatehouse.plans.inputs import TABLES
from gatehouse.plans.registry import all_oracles as oracle_sql
from gatehouse.plans.registry import all_queries as queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def norm(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        return "%.9g" % float(v)
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def test_oracles_belong_to_queries():
    assert set(oracle_sql()) <= set(queries())
    assert set(queries()) <= set(every_query()) and set(oracle_sql()) <= set(every_oracle()) <= set(every_query())
    assert set(queries()) == set(oracle_sql())


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, name):
    df = every_query()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    if name not in oracle_sql():
        assert got
        return
    rel = duck.sql(oracle_sql()[name])
    names = list(rel.columns)
    assert sorted(names) == cols
    assert got == sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in rel.fetchall())


@pytest.mark.parametrize("name", ["pii_redact", "secret_spans", "token_counts", "sql_log_findings", "url_log_findings"])
def test_scans_are_narrow(spark, name):
    assert "Exchange" not in queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
