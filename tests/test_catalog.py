"""Every registered query that has SQL, against DuckDB over the smallest test tables."""

import math
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in DATA.iterdir():
        if p.suffix == ".parquet":
            con.execute(f"create view {p.stem} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if hasattr(v, "as_tuple"):
        return round(float(v), 9)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    df = entry.queries()[name](spark, str(DATA))
    want = duck.execute(SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    expected = rows(columns, want.fetchall())
    assert len(got) == len(expected)
    for a, b in zip(got, expected):
        assert all(x == y or (isinstance(x, (int, float)) and isinstance(y, (int, float)) and abs(x - y) < 1e-9) for x, y in zip(a, b)), (a, b)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(SQL) <= set(entry.queries())
