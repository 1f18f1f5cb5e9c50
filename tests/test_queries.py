"""Every query with SQL gives the rows that DuckDB gives."""

import decimal
import glob
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as contract

from .conftest import DATA


def plain(x):
    if isinstance(x, float):
        return None if x != x else round(x, 6)
    if isinstance(x, decimal.Decimal):
        return round(float(x), 6)
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):
    df = contract.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = Counter(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    answer = duck.execute(contract.oracle_sql()[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = Counter(repr(tuple(plain(r[i]) for i in at)) for r in answer.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(contract.queries()) - set(contract.oracle_sql())))
def test_runs(spark, name):
    df = contract.queries()[name](spark, DATA)
    assert df.count() >= 0 and df.columns


def test_entry(spark):
    assert contract.entry(spark).count() > 0
