"""Registered queries against their SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from basinsift.llm import queries as registered


def cell(v):
    return "~" if v is None else repr(round(v, 3) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registered.oracle_sql()))
def test_query_equals_its_sql(spark, small, name):
    con = duckdb.connect()
    for f in Path(small).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df, relation = registered.queries()[name](spark, small), con.sql(registered.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    at = [relation.columns.index(c) for c in columns]
    assert sorted(tuple(cell(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(cell(r[k]) for k in at) for r in relation.fetchall())
