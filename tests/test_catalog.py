"""Every registered query gives the rows of its comparison SQL; the others give some rows."""

import math
import os

import duckdb
import pandas as pd
import pytest

from sparkevidence.plans.catalog import ORACLES, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SF_DIR}/{name}.parquet'")
    return con


def plain(value):
    if value is None or value is pd.NA:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)) or hasattr(value, "as_tuple"):
        number = float(value)
        return None if math.isnan(number) else round(number, 9) + 0.0
    return str(value)


def rows(frame):
    names = sorted(frame.columns)
    found = [tuple(plain(v) for v in r) for r in frame[names].astype(object).itertuples(index=False)]
    return names, sorted(found, key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF_DIR).toPandas()
    if name not in ORACLES:
        assert len(got.columns) > 0 and len(got) > 0
        return
    want = duck.execute(ORACLES[name]).df()
    assert rows(got) == rows(want)


def test_names_are_unique_and_described():
    assert len(QUERIES) >= 100
    assert set(ORACLES) <= set(QUERIES)
