"""Every registered query of the library against its SQL in DuckDB, whole results at the middle size."""

import datetime
import decimal
import glob
import os

import duckdb
import pytest

import __spark_entry__
from ledgerline.plans import catalog

MIDDLE = "/root/testdata/sf0.01"


def plain(value):
    if isinstance(value, float):
        return round(value, 9)
    return str(value) if isinstance(value, decimal.Decimal | datetime.date) else value


def ordered(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{MIDDLE}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    frame = catalog.QUERIES[name](spark, MIDDLE)
    got = ordered(frame.columns, frame.collect())
    if name not in catalog.ORACLES:
        assert got[1]  # rows; what they hold is tested by itself
        return
    cursor = duck.execute(catalog.ORACLES[name])
    assert got == ordered([d[0] for d in cursor.description], cursor.fetchall())
    assert got[1], "a comparison of nothing"


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
