"""Every catalog query against its SQL on the smallest tables."""

import glob
import os
from decimal import Decimal

import duckdb
import pytest

from chunklake.plans.catalog_queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(found, names):
    plain = lambda v: round(float(v), 6) if isinstance(v, float | Decimal) else v
    return sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in found), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = rows([tuple(r) for r in df.collect()], df.columns)
    if name not in ORACLES:
        assert got
        return
    want = duck.sql(ORACLES[name])
    assert sorted(want.columns) == sorted(df.columns)
    assert got == rows(want.fetchall(), want.columns)


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
