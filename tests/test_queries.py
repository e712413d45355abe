"""Every registered query of the library against its SQL in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from tallyforge.plans import catalog, columns, counting, detection, domains, imaging, relations, reports, sampled  # noqa: F401

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(x):
    if pd.isna(x) if not hasattr(x, "__len__") else False:
        return None
    if isinstance(x, bool) or hasattr(x, "dtype") and x.dtype == bool:
        return bool(x)
    try:
        return round(float(x), 5) + 0.0
    except (TypeError, ValueError):
        return str(x)


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(map(repr, (tuple(map(plain, r)) for r in df.itertuples(index=False, name=None))))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    if name in catalog.ORACLES:
        want = duck.sql(catalog.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got.columns)


def test_all_have_names():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES) and catalog.FLAGSHIP in catalog.QUERIES
