"""Every registered query against DuckDB on the same Parquet files."""

import os

import duckdb
import pandas as pd
import pytest

from rowmill import catalog

SF = os.environ.get("TEST_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(df):
    def cell(x):
        if pd.isna(x):
            return "~"
        if isinstance(x, int | float) and not isinstance(x, bool):
            return repr(round(float(x), 6))
        return str(pd.Timestamp(x)) if hasattr(x, "isoformat") else str(x)

    return sorted(tuple(map(cell, r)) for r in df.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_duckdb(spark, duck, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    want = duck.execute(catalog.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert rows(got[cols]) == rows(want[cols])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_modules_have_names_of_their_own():
    """Two test modules of one name, in two folders, would hide one of them."""
    names = [f for _, _, files in os.walk(os.path.dirname(os.path.abspath(__file__))) for f in files if f.startswith("test_")]
    assert len(names) == len(set(names))
