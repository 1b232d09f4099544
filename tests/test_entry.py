import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from tallyhelix.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem".split()


def cell(v):
    if v is None or (isinstance(v, float) and v != v):
        return "NULL"
    if isinstance(v, np.generic):
        v = v.item()
    return repr(v) if isinstance(v, float) else str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = con.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == cols
    rows = sorted(tuple(cell(r[c]) for c in cols) for r in got.collect())
    spark.catalog.clearCache()
    assert rows == sorted(tuple(cell(r[names.index(c)]) for c in cols) for r in want.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_beyond_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).columns
    QUERIES[name](spark, SF).count()
    spark.catalog.clearCache()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_entry(spark):
    assert entry.entry(spark).count() == 24 * 60
    assert set(entry.oracle_sql()) <= set(entry.queries())
