"""Every query of the engine against its DuckDB twin over the smallest tables."""

import datetime
import math

import duckdb
import numpy as np
import pytest

from driftframe.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages".split()
#: Those that take longest here run in the driver's own comparison only.
SLOW = {"detect_cores", "detect_anvils", "network_watershed"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(map(plain, v))
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if hasattr(v, "is_integer") or type(v).__name__ == "Decimal":
        return None if math.isnan(v) else round(float(v), 5) + 0.0
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(set(registry.oracle_sql())))
def test_matches_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    r = duck.execute(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(c[0] for c in r.description)
    assert rows(df.columns, df.collect()) == rows([c[0] for c in r.description], r.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql()) - SLOW))
def test_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(registry.queries()) <= set(entry.queries())


@pytest.fixture(scope="module")
def uneven(tmp_path_factory):
    """A folder of tables whose cube has steps from 100 on and one that lacks rows."""
    folder, e = tmp_path_factory.mktemp("uneven"), f"read_parquet('{SF}/embeddings.parquet')"
    duckdb.sql(f"select 2000 + vec_id as vec_id, embedding, label from {e} where vec_id < 256 or vec_id = 257").write_parquet(f"{folder}/embeddings.parquet")
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from '{folder}/embeddings.parquet'")
    return str(folder), c


@pytest.mark.parametrize("name", ["fill_holes", "gaussian", "nan_adjacent", "peaks", "ellipse_distance"])
def test_matches_sql_on_uneven_steps(spark, uneven, name):
    folder, c = uneven
    df = registry.queries()[name](spark, folder)
    r = c.execute(registry.oracle_sql()[name])
    assert rows(df.columns, df.collect()) == rows([k[0] for k in r.description], r.fetchall())


def test_same_step_stencil_counts_what_is_there(spark):
    """Nine pixels inside, less those that are missing; each has as many as the SQL's own count of the table."""
    got = {(r.t, r.y, r.x): r.n for r in registry.queries()["same_step_stencil"](spark, SF).where("t = 3 and y < 4 and x < 4").collect()}
    there = lambda t, y, x: 0 <= y < 20 and 0 <= x < 64 and (x + 3 * y + t) % 13 != 0
    assert got == {(3, y, x): sum(there(3, y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)) for y in range(4) for x in range(4)}
