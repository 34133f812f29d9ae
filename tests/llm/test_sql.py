"""Queries with SQL against DuckDB."""

import math

import duckdb
import pytest

from driftframe.llm import queries

SF = "/root/testdata/sf0.001"


def plain(v):
    return round(v, 6) if isinstance(v, float) and not math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    r = c.execute(queries.oracle_sql()[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(plain(v) for _, v in sorted(zip(names, row, strict=True))) for row in r.fetchall()), key=str)
    assert sorted((tuple(plain(v) for _, v in sorted(row.asDict().items())) for row in df.collect()), key=str) == want
