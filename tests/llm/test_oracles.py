"""The SQL of this subpackage's queries against the queries, by DuckDB."""

import duckdb
import pytest

from starweave.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    result = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in result.description]
    df = queries.queries()[name](spark, sf)
    assert df.columns == names
    assert sorted(map(tuple, df.collect()), key=str) == sorted(result.fetchall(), key=str)
