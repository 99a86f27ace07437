"""The registered queries against their SQL in DuckDB."""

from __future__ import annotations

import duckdb
import pytest

from defectlake import llm

from ..conftest import DATA

QUERIES, ORACLE = llm.queries(), llm.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    result = con.execute(ORACLE[name])
    names = sorted(c[0] for c in result.description)
    df = QUERIES[name](spark, sf_dir)
    assert sorted(df.columns) == names
    place = {c[0]: i for i, c in enumerate(result.description)}
    want = sorted(tuple(str(r[place[c]]) for c in names) for r in result.fetchall())
    assert sorted(tuple(str(r[c]) for c in names) for r in df.collect()) == want


def test_each_operator_has_one_query():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 14))
    assert set(ORACLE) <= set(QUERIES)
