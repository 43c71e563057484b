"""Every registered query of the mention operators against its SQL in DuckDB, at the smallest size."""

from __future__ import annotations

import math

import duckdb
import pytest

from mentionloom.plans import catalogue
from tests.conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = f"{DATA}/sf0.001"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: "NULL" if v is None or (isinstance(v, float) and math.isnan(v)) else str(v)
    return sorted(tuple(clean(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    got = catalogue.queries()[name](spark, SF)
    rows = rows_of(got.columns, got.collect())
    if sql := catalogue.oracle_sql().get(name):
        want = duck.sql(sql)
        assert sorted(got.columns) == sorted(want.columns)
        assert rows == rows_of(want.columns, want.fetchall())
    else:
        assert rows


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(e.oracle_sql()) <= set(e.queries())
