"""Every query runs on the smallest tables, and agrees with its SQL where it has one."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from codeloom.plans import catalog
from compare import canonical


@pytest.fixture(scope="module")
def db(sf):
    connection = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return connection


def test_names():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, sf, db, name):
    df = catalog.queries()[name](spark, sf)
    rows = [tuple(r) for r in df.collect()]
    sql = catalog.oracle_sql().get(name)
    if sql:
        result = db.execute(sql)
        columns = [c[0] for c in result.description]
        assert sorted(columns) == sorted(df.columns)
        assert canonical(rows, df.columns) == canonical(result.fetchall(), columns)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
