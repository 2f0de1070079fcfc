"""Queries of this folder that SQL can express, against DuckDB."""

import duckdb
import pytest

from fernweave.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("pages", "conversations", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    made = QUERIES[name](spark, SF)
    columns = sorted(made.columns)
    result = con.execute(ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert sorted((tuple(r[c] for c in columns) for r in made.collect()), key=str) == sorted((tuple(r[names.index(c)] for c in columns) for r in result.fetchall()), key=str)
