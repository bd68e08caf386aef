"""Every registered query of the engine against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from starweave import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.7g}")
    return float(v) if isinstance(v, int) else str(v)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_matches_sql(spark, duck, name):
    df = queries.queries()[name](spark, FOLDER)
    result = duck.execute(queries.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(range(len(names)), key=lambda i: names[i])
    want = sorted((tuple(plain(r[i]) for i in order) for r in result.fetchall()), key=str)
    got = sorted((tuple(plain(r[names[i]]) for i in order) for r in df.collect()), key=str)
    assert got == want


def test_entry_points():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
