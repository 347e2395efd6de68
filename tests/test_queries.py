"""Every ledger query against its SQL at the smallest scale."""

import glob
import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def names():
    from ledgerspark.plans.queries import ORACLES

    return sorted(ORACLES)


@pytest.mark.parametrize("name", names())
def test_query(spark, duck, name):
    from ledgerspark.plans.queries import ORACLES, QUERIES

    out = QUERIES[name](spark, SF)
    want = duck.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(out.columns)
    got = sorted(map(repr, (tuple(r[c] for c in sorted(columns)) for r in out.collect())))
    order = [columns.index(c) for c in sorted(columns)]
    assert got == sorted(repr(tuple(r[i] for i in order)) for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["addr", "cluster"]
    assert set(e.oracle_sql()) <= set(e.queries())
