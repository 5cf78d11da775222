"""Every registered query against its DuckDB oracle on the smallest tables.

The same comparison (row count, column names, order-insensitive values with
doubles rounded to 6 places) the verify step makes at sf0.01.
"""

import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from quarry.plans.tables import TABLES

SF = "/root/testdata/sf0.001"
QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


def _norm(v):
    import pandas as pd

    if v is None or v is pd.NA:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _bag(pdf):
    cols = sorted(pdf.columns)
    return cols, Counter(tuple(_norm(x) for x in rec) for rec in pdf[cols].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_parity(spark, con, name):
    sp = QUERIES[name](spark, SF).toPandas()
    dk = con.execute(ORACLES[name]).df()
    assert _bag(sp) == _bag(dk)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_contract(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "rank", "doc_id", "score", "method"]
    assert df.count() > 0
    assert set(ORACLES) <= set(QUERIES)
