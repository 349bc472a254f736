"""Every query against its SQL in DuckDB."""

import datetime as dt
import math
from collections import Counter

import duckdb
import pytest

from tessera import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 4)
    if isinstance(x, dt.datetime):
        return x.replace(tzinfo=None)
    if isinstance(x, list):
        return tuple(map(plain, x))
    return plain(float(x)) if type(x).__name__ == "Decimal" else x


def rows(columns, found):
    at = sorted(range(len(columns)), key=lambda k: columns[k])
    return Counter(tuple(plain(r[k]) for k in at) for r in found)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = df.collect()
    if name not in catalog.SQL:
        assert got
        return
    rel = duck.sql(catalog.SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    a, b = rows(df.columns, got), rows(rel.columns, rel.fetchall())
    assert a == b, (list((a - b).items())[:3], list((b - a).items())[:3])
