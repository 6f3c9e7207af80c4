import os
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry_module
from stockweave.plans import ORACLES, QUERIES


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.count() > 0 and "tarih_saat" in df.columns


def test_every_oracle_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf_dir}/{f}'")
    return con


def plain(x):
    return round(float(x), 6) if isinstance(x, (float, Decimal)) else x


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_as_in_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    cur = duck.execute(ORACLES[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    rows = lambda data: sorted((tuple(map(plain, r)) for r in data), key=str)
    assert rows(df.select(*cols).collect()) == rows(cur.fetchall())
