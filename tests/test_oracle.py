"""Every registered query against its DuckDB oracle on the smallest data set
(the driver runs the same comparison at sf0.01)."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as se  # noqa: E402
from check_oracle import TABLES, digest  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="generated test data not present")
@pytest.mark.parametrize("name", sorted(se.oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    df = se.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    sql = se.oracle_sql()[name]
    res = duck.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(rows) == len(drows)
    assert digest(df.columns, rows) == digest(dcols, drows)


def test_every_catalogue_query_has_an_oracle():
    from shelfspark.plans.registry import queries
    assert set(queries()) <= set(se.oracle_sql())


@pytest.mark.skipif(not os.path.isdir(SF), reason="generated test data not present")
def test_entry_smoke(spark):
    df = se.entry(spark)
    assert len(df.collect()) >= 0 and "sku_code" in df.columns
