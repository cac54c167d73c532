"""The operators that SQL can express against DuckDB on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from fieldloom.llm import queries

SF = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not SF.exists(), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        path = SF / f"{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if path.is_file() else path / '*.parquet'}'")
    got, want = queries.QUERIES[name](spark, str(SF)), con.sql(queries.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want.select(*columns).fetchall())
