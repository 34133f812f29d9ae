import numpy as np
import pytest
from pyspark.sql import functions as F

from driftframe.llm import ann, queries


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall_and_exact_scores(spark, sf):
    sf_dir = f"/root/testdata/{sf}"
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas().sort_values("vec_id")
    x, ids = np.array([np.asarray(v, float) for v in e["embedding"]]), e["vec_id"].to_numpy()
    length = np.linalg.norm(x, axis=1)
    got = dict(tuple(queries.op1_cross_polytope(spark, sf_dir).toPandas().groupby("query_id")))
    hits = 0
    wanted = np.flatnonzero(ids % 50 == 0)
    for i in wanted:
        s = (x * x[i]).sum(axis=1) / (length * length[i])
        s[i] = -2
        best, g = ids[np.lexsort((ids, -s))[:5]], got[ids[i]].sort_values("rank")
        assert list(g["rank"]) == [1, 2, 3, 4, 5]
        assert np.allclose(s[np.searchsorted(ids, g["vec_id"])], g["score"], atol=1e-12)
        hits += len(set(best) & set(g["vec_id"]))
    assert hits >= 0.9 * 5 * len(wanted)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [2.0, 0.0]), (6, [1e300, 1e300]), (7, [1.0]), (None, [1.0, 1.0]), (8, [-3.0, 0.0]), (9, [4.0, 0.0])]
    table = spark.createDataFrame([(*r, "clash", 1.0) for r in rows], "vec_id long, embedding array<double>, vector string, score double")
    v = ann.vectors(table)
    got = ann.search(v, v.where("vec_id = 0"), k=5, probes=4).orderBy("rank").collect()
    assert [(r["vec_id"], round(r["score"], 6)) for r in got] == [(5, 1.0), (9, 1.0), (6, 0.707107), (8, -1.0)]
    assert ann.search(v.limit(0), v).count() == 0 and ann.search(v, v.limit(0)).count() == 0


def test_lengths_apart(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0]), (2, [-2.0]), (3, [0.5, 0.5]), (4, [])]
    v = ann.vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {(r["query_id"], r["vec_id"], round(r["score"], 6)) for r in ann.search(v, v).collect()}
    assert got == {(0, 3, 0.707107), (3, 0, 0.707107), (1, 2, -1.0), (2, 1, -1.0)}


@pytest.mark.parametrize("n", [1, 3, 6, 9])
def test_all_candidates_of_small_tables(spark, n):
    x = np.random.default_rng(n).normal(size=(n, 64))
    v = ann.vectors(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>"))
    got = ann.search(v, v).groupBy("query_id").count().collect()
    assert {r["query_id"]: r["count"] for r in got} == ({i: min(5, n - 1) for i in range(n)} if n > 1 else {})


def test_deeper_buckets(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(150, 64))
    x = np.repeat(centres, 20, axis=0) + 0.6 * rng.normal(size=(3000, 64))
    v = ann.vectors(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>"))
    got = ann.search(v, v.where("vec_id % 50 = 0"), depth=2).toPandas().groupby("query_id")["vec_id"].agg(set)
    s = x / np.linalg.norm(x, axis=1)[:, None]
    hits = 0
    for q in range(0, 3000, 50):
        c = s @ s[q]
        c[q] = -2
        hits += len(got[q] & set(np.argsort(-c)[:5].tolist()))
    assert hits >= 0.9 * 5 * 60


def test_many_equal_vectors_in_blocks(spark):
    v = spark.range(3000).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("vector"))
    got = ann.search(v, v.where("vec_id = 1"), k=3, block=100).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [0, 2, 3]


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 16))
    assert np.allclose(np.linalg.norm(ann.hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    assert np.allclose(ann.hadamard(ann.hadamard(x)), x)
