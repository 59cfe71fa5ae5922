"""Every registered query with SQL gives the rows DuckDB gives, on the smallest driver tables."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from paperloom import queries as core
from tests.conftest import DATA

SMALL = DATA / "sf0.001"
pytestmark = pytest.mark.skipif(not SMALL.exists(), reason="driver tables are not here")


def normal(df):
    def value(v):
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
            return None
        if hasattr(v, "tolist"):
            v = v.tolist()
        return round(v, 6) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    df = df[sorted(df.columns)].astype(object)
    return list(df.columns), sorted(repr([value(v) for v in r]) for r in df.values.tolist())


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(spark, name):
    got = core.QUERIES[name](spark, str(SMALL)).toPandas()
    assert not got.columns.duplicated().any()
    if name in core.ORACLE:
        con = duckdb.connect()
        for f in SMALL.glob("*.parquet"):
            con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
        assert normal(got) == normal(con.sql(core.ORACLE[name]).df())


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1
