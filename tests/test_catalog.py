"""Every registered query of the engine against its SQL on the smallest tables."""

import datetime
import math
import os

import duckdb
import pandas as pd
import pytest

from corvane.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if x is None or x is pd.NA or x is pd.NaT or isinstance(x, float) and math.isnan(x):
        return None
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, bool):
        return int(x)
    if isinstance(x, float):
        return round(x, 5)
    return str(x) if isinstance(x, datetime.datetime) else x


def rows(frame: pd.DataFrame) -> list:
    frame = frame[sorted(frame.columns)]
    return sorted(([plain(x) for x in r] for r in frame.itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    want = duck.sql(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert [[float(x) if isinstance(x, int) else x for x in r] for r in rows(got)] == [[float(x) if isinstance(x, int) else x for x in r] for r in rows(want)]


def test_names_are_those_of_queries():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
