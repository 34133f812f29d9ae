"""Closures of undirected and directed links, files linked as they arrive, and labels over many steps."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from driftframe.operators import incremental, kernels, linking
from driftframe.plans import registry


def roots_of(df):
    return {r["node"]: r["root"] for r in df.collect()}


@pytest.mark.parametrize("hub", [0, 100_000])
def test_a_hub_of_many_leaves_has_no_group_of_its_links(spark, hub):
    edges = spark.range(1, 200_001).select(F.lit(hub).cast("long").alias("src"), (F.col("id") + hub).alias("dst"))
    near, far = linking.dealt(edges)
    assert near.groupBy("bucket", "part").count().agg(F.max("count")).first()[0] <= 1 << linking.BUCKET_BITS
    assert near.count() + far.count() == 200_000
    got = linking.components(edges)
    assert got.count() == 200_001 and got.where(F.col("root") != hub).isEmpty()


def test_a_full_bucket_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(linking, "GROUP_LINKS", 50)
    rnd = random.Random(1)
    pairs = [(rnd.randint(0, 400), rnd.randint(0, 400)) for _ in range(500)]
    edges = spark.createDataFrame(pairs, "src long, dst long")
    near, _ = linking.dealt(edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")))
    parts = near.groupBy("bucket", "part").count().collect()
    assert len(parts) == 10 and max(r["count"] for r in parts) < 150
    nodes, low = kernels.stars(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
    want = dict(zip(nodes.tolist(), low.tolist(), strict=True))
    assert {k: v for k, v in roots_of(linking.components(edges)).items() if k in want} == want


def discovered(edges):
    links = {}
    for a, b in edges:
        links.setdefault(a, []).append(b)
    return kernels.ordered_groups(sorted({x for e in edges for x in e}), links, {})


def test_ancestors_are_the_order_of_discovery(spark):
    rnd, edges = random.Random(7), []
    for g in range(150):  # small graphs side by side, of every density
        n = rnd.randint(2, 12)
        edges += [(100 * g + rnd.randrange(n), 100 * g + rnd.randrange(n)) for _ in range(rnd.randint(1, 3 * n))]
    n = 20_000  # and a chain of rising numbers, a falling one, a ring, and rises and falls by turns
    chain = [(n + i, n + i + 1) for i in range(600)]
    falling = [(3 * n - i, 3 * n - i - 1) for i in range(600)]
    ring = [(4 * n + i, 4 * n + (i + 7) % 40) for i in range(40)]
    zigzag = [x for i in range(12) for x in ((5 * n - i, 6 * n + i), (6 * n + i, 5 * n - i - 1))]
    edges += [*chain, *falling, *ring, *zigzag]
    got = roots_of(linking.ancestors(spark.createDataFrame(edges, "src long, dst long")))
    want = discovered(edges)
    assert got == {k: v for k, v in want.items() if k in got}
    assert all(a == b for a, b in edges if a not in got or b not in got)  # only nodes that just link themselves are left out


def test_chains_of_links_both_ways_take_few_rounds(spark, monkeypatch):
    """An object over 3,000 steps, linked forwards and backwards."""
    rounds = []
    whole = linking.stored
    monkeypatch.setattr(linking, "stored", lambda df: rounds.append(1) or whole(df))
    chain = spark.range(3000).select((F.col("id") * 37 + 5).alias("src"), (F.col("id") * 37 + 42).alias("dst"))
    got = linking.ancestors(chain.union(chain.select(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    assert got.where("root <> 5").isEmpty() and got.count() == 3001 and len(rounds) < 20


def files_of(rnd, n_files=5, steps=7, overlap=4):
    """``file, t, y, x, label`` of boxes that drift, merge and end, labelled anew in each file."""
    rows = []
    for f in range(n_files):
        names = {}
        for t in range(f * (steps - overlap), f * (steps - overlap) + steps):
            for y in range(6):
                for x in range(12):
                    o = (x + t) // 4 if (t // 5 + y) % 3 else 0
                    hole = rnd.random() < 0.15
                    rows.append((f, t, y, x, 0 if hole or not o else names.setdefault((o, y // 2), len(names) + 1)))
    return rows


def test_files_one_by_one_are_the_batch(spark, tmp_path):
    rows = files_of(random.Random(2))
    pixels = spark.createDataFrame(rows, "file long, t int, y int, x int, label int")
    table = incremental.LinkTable(spark, str(tmp_path / "links"))
    assert table.last() is None
    for f in range(5):
        table.add(str(f), pixels.where(F.col("file") == f).drop("file"))
    want = {(str(r["file"]), r["label"], r["global_label"]) for r in linking.link_map(pixels).collect()}
    assert {(r["file"], r["label"], r["global_label"]) for r in table.label_map().collect()} == want
    # the table of a file that was added isn't written again, and what was interrupted doesn't count
    table._write("labels", 5, spark.createDataFrame([(1, 10**6, 10**6)], incremental.SCHEMAS["labels"]))
    assert {(r["file"], r["label"], r["global_label"]) for r in table.label_map().collect()} == want
    again = incremental.LinkTable(spark, str(tmp_path / "links"))
    assert again.last()["file"] == "4"
    # a file without common steps begins its own objects
    again.add("far", spark.createDataFrame([(900, 0, 0, 3)], "t int, y int, x int, label int"))
    top = max(g for *_, g in want)
    assert [(r["label"], r["global_label"]) for r in again.label_map().where("file = 'far'").collect()] == [(3, top + 1)]
    with pytest.raises(KeyError):
        again.output("none")


def plain_merge(own, other, join):
    steps = sorted({t for t, _, _ in own} & {t for t, _, _ in other})
    if not steps:
        return own
    edge = steps[-1 if join == "start" else 0]
    held = {v for (t, _, _), v in own.items() if t in steps}
    stubs = {v for (t, _, _), v in other.items() if t == edge} - held
    fill = {k: v for k, v in other.items() if k[0] in steps[1:-1] and v not in stubs}
    return {k: v or fill.get(k, 0) for k, v in own.items()}


@pytest.mark.parametrize("join", ["start", "end"])
def test_merging_leaves_stubs_out(spark, join):
    rnd = random.Random(4)
    cube = lambda lo, hi: {(t, y, x): rnd.choice([0, 0, 1, 2, 3, 10 * t]) for t in range(lo, hi) for y in range(2) for x in range(5)}
    own, other = (cube(4, 12), cube(0, 9)) if join == "start" else (cube(0, 9), cube(4, 12))
    table = lambda d: spark.createDataFrame([(*k, v) for k, v in d.items()], "t int, y int, x int, label long")
    got = {(r["t"], r["y"], r["x"]): r["label"] for r in incremental.merge_labels(table(own), table(other), join).collect()}
    assert got == plain_merge(own, other, join)
    with pytest.raises(ValueError):
        incremental.merge_labels(table(own), table(other), "middle")


@pytest.fixture(scope="module")
def long_cube(tmp_path_factory):
    """Embeddings of 1,100 steps, each of 20 rows and 64 columns."""
    folder, rng = tmp_path_factory.mktemp("long"), np.random.default_rng(5)
    n = 1100 * 20
    values = pa.array(list(rng.normal(0, 0.125, (n, 64)).astype(np.float32)), pa.list_(pa.float32()))
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": values, "label": np.zeros(n, np.int32)}), folder / "embeddings.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["nan_adjacent", "label_properties", "filter_by_length", "cross_file_edges", "cross_file_components"])
def test_labels_over_more_than_a_thousand_steps(spark, long_cube, name):
    got = registry.queries()[name](spark, long_cube)
    with duckdb.connect() as db:
        db.execute(f"create view embeddings as select * from '{long_cube}/embeddings.parquet'")
        db.register("got", got.toArrow())
        columns = ", ".join(f'"{c}"' for c in got.columns)
        assert db.sql(f"select count(*) from (select {columns} from got except all select {columns} from ({registry.oracle_sql()[name]}))").fetchall() == [(0,)]
        assert db.sql(f"select (select count(*) from got) = (select count(*) from ({registry.oracle_sql()[name]}))").fetchall() == [(True,)]


def test_a_label_has_one_step_over_more_than_a_thousand(spark, long_cube):
    assert registry.queries()["nan_adjacent"](spark, long_cube).count() == 1100 * 16


def test_a_job_links_the_next_file_and_writes_the_one_before(spark, tmp_path):
    from driftframe.plans import jobs

    pixels = spark.createDataFrame(files_of(random.Random(6), n_files=3), "file long, t int, y int, x int, label int")
    for f in range(3):
        pixels.where(F.col("file") == f).drop("file").write.parquet(str(tmp_path / f"f{f}"))
        jobs.main(["link-next", "--input", str(tmp_path / f"f{f}"), "--table", str(tmp_path / "table"), "--output", str(tmp_path / "out")])
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["f0", "f1"]
    table = incremental.LinkTable(spark, str(tmp_path / "table"))
    known = {(r["file"], r["label"]): r["root"] for r in table.label_map().collect()}
    moved = {r["node"] for r in table._all("moves").collect()}
    got = {r["label"] for r in spark.read.parquet(str(tmp_path / "out" / "f0")).where("label <> 0").collect()}
    assert got <= {v for (f, _), v in known.items() if f in ("f0", "f1")} | moved


def test_a_kept_table_of_many_rows_in_few_bytes_is_not_broadcast(spark):
    """Files of 1,048,576 rows are under the 10 MB up to which Spark broadcasts by default; the rows are over 40."""
    from driftframe.sources.store import stored

    rows = spark.range(1 << 20).select((F.col("id") / 1280).cast("int").alias("t"), (F.col("id") % 20).cast("int").alias("y"), F.pmod(F.hash("id"), F.lit(64)).alias("x"))
    kept, other = stored(rows), rows.withColumn("m", F.lit(True))
    for one in (kept, kept.groupBy("t", "y").agg(F.max("x").alias("x"))):
        plan = other.join(one, "t")._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    small = stored(rows.where("t < 2"))
    assert "BroadcastHashJoin" in other.join(small, "t")._jdf.queryExecution().executedPlan().toString()
