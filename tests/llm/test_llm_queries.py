"""Every training-data query gives the rows of its comparison SQL."""

import math
import os

import duckdb
import pandas as pd
import pytest

from sparkevidence.llm.catalog import ORACLES, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SF_DIR}/{name}.parquet'")
    return con


def plain(value):
    if value is None or value is pd.NA:
        return None
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return None if math.isnan(float(value)) else round(float(value), 9) + 0.0
    return str(value)


def rows(frame):
    names = sorted(frame.columns)
    found = [tuple(plain(v) for v in r) for r in frame[names].astype(object).itertuples(index=False)]
    return names, sorted(found, key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF_DIR).toPandas()
    assert rows(got) == rows(duck.execute(ORACLES[name]).df())


def test_each_operator_has_a_query():
    numbers = sorted(int(x[2:].split("_")[0]) for x in QUERIES)
    assert numbers == list(range(1, 14))
