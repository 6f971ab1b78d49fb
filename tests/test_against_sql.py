"""Every query with SQL agrees with DuckDB on whole tables."""

import decimal
import math
from pathlib import Path

import duckdb
import pytest

from repolens.plans import further  # noqa: F401 - registers its queries
from repolens.plans.queries import QUERIES, SQL


def plain(x):
    if isinstance(x, bool):
        return x
    if isinstance(x, int | float | decimal.Decimal):
        return None if math.isnan(x) else round(float(x), 6)
    return x


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in Path(data).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, data, duck):
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    if name not in SQL:
        return
    rel = duck.sql(SQL[name])
    assert sorted(rel.columns) == columns
    want = sorted((tuple(plain(r[rel.columns.index(c)]) for c in columns) for r in rel.fetchall()), key=str)
    assert got == want
