"""Every registered query runs, and equals its SQL in DuckDB where it has one."""

import math
import os

import pytest

import __spark_entry__

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(n for n in __spark_entry__.queries() if not n.startswith("op") and n != "pipeline")


@pytest.fixture(scope="module")
def duck(sf):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return float(v) if v.__class__.__name__ == "Decimal" else v


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf, duck, name):
    df = __spark_entry__.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    sql = __spark_entry__.oracle_sql().get(name)
    if sql is None:
        return
    cursor = duck.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in cursor.fetchall()), key=repr)
    assert got == want


def test_entry(spark, sf):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
