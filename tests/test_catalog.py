"""Every query of the engine against its oracle, on the smallest tables."""

import datetime
import decimal
import os

import duckdb
import pytest

from marketlens.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float | decimal.Decimal):
        return round(float(v), 8) + 0.0
    return str(v) if isinstance(v, datetime.date) else v


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    if name not in catalog.ORACLES:
        return
    cur = duck.execute(catalog.ORACLES[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == columns
    assert got == sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in cur.fetchall())
