"""Each query that SQL can express, against its SQL in DuckDB."""

import duckdb
import pytest

from sparkwright.llm.workloads import ORACLES, QUERIES

from .helpers import SF


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    found = con.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(found.fetchall())
