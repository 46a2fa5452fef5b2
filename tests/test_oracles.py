"""Every registered query that has an oracle, against DuckDB on sf0.001, plus the entry."""
import math

import duckdb
import pytest

import __spark_entry__ as E
from gradelens.plans import registry
from gradelens.sources.tables import TABLES

from conftest import SF_SMOKE

SQL = registry.oracle_sql()
# The whole searches take minutes each; the queries that score with a fitted model get one of a small search here.
pytestmark = pytest.mark.usefixtures("small_searches")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMOKE}/{t}.parquet')")
    return c


def _norm(row):
    return tuple(None if isinstance(v, float) and math.isnan(v) else v for v in row)


def _key(row):
    return tuple((v is None, str(v)) for v in row)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    sdf = E.queries()[name](spark, SF_SMOKE)
    res = con.execute(SQL[name])
    dcols = [d[0] for d in res.description]
    assert sorted(sdf.columns) == sorted(dcols)
    s_rows = sorted((_norm(tuple(r[c] for c in sorted(sdf.columns))) for r in sdf.collect()), key=_key)
    idx = [dcols.index(c) for c in sorted(sdf.columns)]
    d_rows = sorted((_norm(tuple(r[i] for i in idx)) for r in res.fetchall()), key=_key)
    assert s_rows == d_rows


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "pass_rate" in df.columns
