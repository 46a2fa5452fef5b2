"""A hot key holding a third of the rows must not change any result.

The fixture is derived from the sf0.001 tables: a third of all orders move
to customer 1 and a third of all events to user 0.  The cohort view, the
cleaned cohort and the profile are compared with their DuckDB oracles on it.
"""
import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from gradelens.sources.tables import TABLES

from conftest import SF_SMOKE


@pytest.fixture(scope="module")
def skewed_dir(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("skewed"))
    for t in TABLES:
        df = spark.read.parquet(f"{SF_SMOKE}/{t}.parquet")
        if t == "orders":
            df = df.withColumn("o_custkey", F.when(F.col("o_orderkey") % 3 == 0, F.lit(1).cast("bigint"))
                               .otherwise(F.col("o_custkey")))
        if t == "events":
            df = df.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, F.lit(0).cast("bigint"))
                               .otherwise(F.col("user_id")))
        df.write.parquet(f"{out}/{t}.parquet")
    return out


@pytest.mark.parametrize("name", ["cohort_base", "clean_median_mode", "profile_columns", "cohort_summary_by_class",
                                  "describe_cohort"])
def test_hot_keys_do_not_change_results(spark, skewed_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{skewed_dir}/{t}.parquet')")
    sdf = E.queries()[name](spark, skewed_dir)
    res = con.execute(E.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    order = sorted(sdf.columns)
    key = lambda r: tuple((v is None, str(v)) for v in r)
    s_rows = sorted((tuple(r[c] for c in order) for r in sdf.collect()), key=key)
    d_rows = sorted((tuple(r[cols.index(c)] for c in order) for r in res.fetchall()), key=key)
    assert s_rows == d_rows
    assert con.execute("SELECT count(*) FROM orders WHERE o_custkey = 1").fetchone()[0] * 3 >= \
        con.execute("SELECT count(*) FROM orders").fetchone()[0]
