"""Every registered query against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from defectlake import catalog

from .conftest import DATA

QUERIES, ORACLE = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _norm(value):
    if isinstance(value, float):
        return None if value != value else repr(round(value, 6))
    return None if value is None else str(value)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    result = duck.execute(ORACLE[name])
    names = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    want = sorted((tuple(_norm(r[names.index(c)]) for c in order) for r in result.fetchall()), key=str)
    got = sorted((tuple(_norm(r[c]) for c in order) for r in df.collect()), key=str)
    assert got == want


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
