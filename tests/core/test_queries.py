"""Every query with SQL gives the SQL's rows; the others give rows that hold what they promise."""

import decimal
import glob
import math
import os

import duckdb
import pytest

from mnemospark.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else ("f", round(v, 5))
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_is_its_sql(spark, con, name):
    got = QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = con.sql(ORACLES[name])
    assert sorted(want.columns) == cols
    rows = want.project(",".join(f'"{c}"' for c in cols)).fetchall()
    key = lambda r: repr(tuple(map(plain, r)))
    assert sorted(map(key, (tuple(r[c] for c in cols) for r in got.collect()))) == sorted(map(key, rows))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"dedup_semantic", "batch_add_ids"}))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).collect()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
