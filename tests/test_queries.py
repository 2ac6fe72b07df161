"""Every registered query against its DuckDB oracle on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from basinsift.oracles import ORACLES
from basinsift.queries import QUERIES


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "~"
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


def same(df, relation):
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    at = [relation.columns.index(c) for c in columns]
    ours = sorted(tuple(cell(r[c]) for c in columns) for r in df.collect())
    theirs = sorted(tuple(cell(r[k]) for k in at) for r in relation.fetchall())
    assert ours == theirs


@pytest.fixture(scope="module")
def tables(small):
    con = duckdb.connect()
    for f in Path(small).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def test_all_have_oracles():
    assert set(QUERIES) == set(ORACLES)
    assert len(QUERIES) == 111


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, tables, name):
    same(QUERIES[name](spark, small), tables.sql(ORACLES[name]))
