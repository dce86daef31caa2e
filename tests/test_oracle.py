"""Every registered query against its SQL on the same tables; queries without SQL must at least return rows."""

import datetime
import decimal
import math

import duckdb
import pytest

from tests.conftest import DATA
from touchline.catalog import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 8) + 0.0
    if isinstance(value, decimal.Decimal):
        return round(float(value), 8)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def sort_key(row):
    return tuple((v is None, "n" if isinstance(v, (int, float)) else type(v).__name__, 0 if v is None else v) for v in row)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    ours = sorted((tuple(plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=sort_key)
    cursor = duck.execute(ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    theirs = sorted((tuple(plain(r[i]) for i in order) for r in cursor.fetchall()), key=sort_key)
    assert ours == theirs


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
