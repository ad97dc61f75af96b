"""Queries that SQL can express, against DuckDB over the whole tables."""

from __future__ import annotations

import duckdb
import pytest

from tapeflow.llm.queries import ORACLE, QUERIES
from tests.conftest import SF_SMALL
from tools.oracle_check import frame_hash


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    want = con.execute(ORACLE[name]).df()
    got = QUERIES[name](spark, SF_SMALL).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert frame_hash(got) == frame_hash(want)
