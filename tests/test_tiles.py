"""What is worked out by tiles, rows and blocks equals what the whole frame gives."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from driftframe.functions import normalise
from driftframe.operators import frames, kernels, morphology, stencil, tracking


def rows_of(spark, a, name, kind, skip=None):
    rows = [(*map(int, p), None if kind == "double" and np.isnan(a[p]) else a[p].item()) for p in np.ndindex(a.shape) if skip is None or not skip[p]]
    return spark.createDataFrame(rows, f"t int, y int, x int, {name} {kind}")


def cube_of(df, shape, name, fill=np.nan):
    out = np.full(shape, fill)
    for r in df.collect():
        out[r["t"], r["y"], r["x"]] = np.nan if r[name] is None else r[name]
    return out


@pytest.mark.parametrize("diagonal", [False, True])
@pytest.mark.parametrize("tile", [3, 16])
def test_regions_over_borders_of_tiles(spark, tile, diagonal):
    rng = np.random.default_rng(tile)
    mask = rng.random((4, 17, 23)) < np.array([0.5, 0.62, 0.45, 0.0])[:, None, None]
    got, n = cube_of(tracking.flat_label(rows_of(spark, mask, "m", "boolean"), diagonal, tile), mask.shape, "label"), 0
    for t in range(4):
        want = kernels.components(mask[t], diagonal)
        assert (got[t] == np.where(want > 0, want + n, 0)).all()
        n += want.max()


def test_regions_of_the_cube_by_small_tiles(spark):
    from driftframe.plans import fixtures as fx

    mask = fx.mask(spark, "/root/testdata/sf0.001")
    a, b = (tracking.flat_label(mask, tile=tile) for tile in (16, 512))
    assert a.exceptAll(b).isEmpty() and a.count() == b.count() == mask.count()
    assert tracking.flat_label(mask.limit(0)).count() == 0


def test_distances_by_rows(spark):
    rng = np.random.default_rng(3)
    mask = rng.random((4, 45, 19)) < np.array([0.01, 0.2, 0.0, 0.004])[:, None, None]
    skip = (rng.random(mask.shape) < 0.3) & ~mask
    skip[:3] = False  # the last step lacks pixels, which distances go through all the same
    got = cube_of(frames.distance(rows_of(spark, mask, "m", "boolean", skip)), mask.shape, "v")
    for t in range(4):
        want = kernels.distance(mask[t])[0]
        assert np.allclose(got[t], np.where(np.isfinite(want) & ~skip[t], want, np.nan), equal_nan=True)


@pytest.mark.parametrize("size", [1, 2, 5, 8, 40])
def test_sliding_extremes_of_blocks(size):
    rng = np.random.default_rng(size)
    for shape in ((1, 1), (7, 3), (16, 8), (9, 31)):
        a = rng.normal(size=shape)
        for f, whole in ((np.maximum, np.max), (np.minimum, np.min)):
            got, b = kernels.sliding(a, size, f), size // 2
            want = [[whole(a[max(0, y - b) : y - b + size, max(0, x - b) : x - b + size]) for x in range(shape[1])] for y in range(shape[0])]
            assert (got == np.array(want)).all()


@pytest.mark.parametrize(("size", "tile"), [(4, 5), (7, 3), (30, 8)])
def test_local_norm_by_tiles(spark, size, tile):
    rng = np.random.default_rng(size)
    a = rng.normal(size=(2, 13, 21))
    a[rng.random(a.shape) < 0.1] = np.nan
    a[1, 3:6] = 0.5
    got = cube_of(normalise.local_linear_norm(rows_of(spark, a, "v", "double"), ["t"], size=size, tile=tile), a.shape, "v")
    assert np.allclose(got, np.stack([kernels.local_range(x, size) for x in a]))


def test_stencils_shuffle_no_row_for_each_tap(spark):
    """One shuffle and no join, and the same over the edges of tiles and blocks of steps as a plain loop."""
    rng = np.random.default_rng(3)
    a = rng.random((19, 9, 131)) < 0.97
    rows = spark.createDataFrame([(*map(int, p), bool(a[p])) for p in np.ndindex(a.shape) if (p[0] + p[1] * p[2]) % 29], "t int, y int, x int, m boolean")
    there = {(r.t, r.y, r.x): r.m for r in rows.collect()}
    for got, of in ((morphology.erode(rows, stencil.full()), all), (morphology.dilate(rows, stencil.full()), any)):
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
        taps = lambda t, y, x: [there.get((t + i, y + j, x + k), False) for i, j, k in stencil.full()]
        assert {(r.t, r.y, r.x): r.m for r in got.collect()} == {p: of(taps(*p)) for p in there}
    still = stencil.FlowFrame(rows.select("t", "y", "x", *(F.lit(0.5).alias(c) for c in ("fx", "fy", "bx", "by"))))
    for one in (stencil.taps(rows.withColumn("v", F.lit(1.0)), still.df, [(1, 0, 0)], "cubic"), stencil.local_min(rows.withColumn("v", F.lit(1.0)), still.df, stencil.full(1))):
        assert "Join" not in one._jdf.queryExecution().executedPlan().toString()


def test_frames_and_tiles_come_as_one_stream(spark):
    """Small frames cost no group each, and those that several Arrow batches bring are whole, with holes and NULL as before."""
    rnd = np.random.default_rng(7)
    cube = rnd.normal(size=(40, 5, 6))
    gone, there = rnd.random(cube.shape) < 0.1, rnd.random(cube.shape) > 0.1
    rows = [(*map(int, p), None if gone[p] else float(cube[p])) for p in np.ndindex(cube.shape) if there[p]]
    field = spark.createDataFrame(rows, "t int, y int, x int, v double").repartition(3)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, 7)
    try:
        got = frames.per_frame(field, lambda a: a + np.nansum(a) + a.shape[0], box=(0, 6, 0, 5))
        parts, _ = tracking.tile_regions(field.select("t", "y", "x", (F.col("v") > 0).alias("m")), tile=4)
        for df in (got, parts):
            assert "FlatMapGroupsInPandas" not in df._jdf.queryExecution().executedPlan().toString()
        found = {(r["t"], r["y"], r["x"]): r["v"] for r in got.collect()}
        labels = {(r["t"], r["y"], r["x"]): r["part"] for r in parts.collect()}
    finally:
        spark.conf.set(name, before)
    a = np.where(gone | ~there, np.nan, cube)
    want = a + np.nansum(a, axis=(1, 2), keepdims=True) + 7
    assert found.keys() == {r[:3] for r in rows}
    assert all(v is None if np.isnan(want[p]) else abs(v - want[p]) < 1e-9 for p, v in found.items())
    plain = {}
    for t in range(40):
        for y0 in range(0, 5, 4):
            for x0 in range(0, 6, 4):
                regions = kernels.components(a[t, y0 : y0 + 4, x0 : x0 + 4] > 0)
                for p in zip(*np.nonzero(regions), strict=True):
                    first = np.argwhere(regions == regions[p])[0]
                    plain[t, p[0] + y0, p[1] + x0] = (t * 5 + first[0] + y0) * 6 + first[1] + x0
    assert labels.keys() == plain.keys() and labels == plain
