"""Every query with SQL gives what DuckDB gives on the same tables; every other one gives rows."""

from __future__ import annotations

import math
import os

import duckdb
import pandas as pd
import pytest

from mediaweave.plans import catalog

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(x):
        if x is None or x is pd.NA or x is pd.NaT or isinstance(x, float) and math.isnan(x):
            return "~"
        if isinstance(x, bool) or str(getattr(x, "dtype", "")) == "bool":
            return str(bool(x))
        return repr(round(float(x), 9)) if isinstance(x, int | float) or hasattr(x, "dtype") else str(x)

    return sorted(tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF_DIR):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF_DIR}/{name}'")
    return con


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF_DIR).toPandas()
    if name in catalog.ORACLES:
        want = duck.execute(catalog.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got)


def test_flagship_has_the_known_number_of_clusters(spark):
    assert catalog.QUERIES["similarity_clusters"](spark, "/root/testdata/sf0.001").count() == 880
