"""Analytic cases and brute-force comparisons of kernels and operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftframe.functions import geo, normalise
from driftframe.operators import entities, flooding, frames, kernels, labels, linking, morphology, regrid, stencil, tracking
from driftframe.sources import files


def pixels(spark, a, name="v"):
    a = np.asarray(a)
    kind = {"b": "boolean", "i": "int", "f": "double"}[a.dtype.kind]
    rows = [(int(t), int(y), int(x), None if kind == "double" and np.isnan(a[t, y, x]) else a[t, y, x].item()) for t, y, x in np.ndindex(a.shape)]
    return spark.createDataFrame(rows, f"t int, y int, x int, {name} {kind}")


def array(df, shape, name="v"):
    out = np.full(shape, np.nan)
    for r in df.collect():
        if r[name] is not None:
            out[r["t"], r["y"], r["x"]] = r[name]
    return out


def constant_flow(spark, shape, fx=0.0, fy=0.0):
    rows = [(t, y, x, fx, fy, -fx, -fy) for t, y, x in np.ndindex(*shape)]
    return spark.createDataFrame(rows, "t int, y int, x int, fx double, fy double, bx double, by double")


@pytest.mark.parametrize("fx,fy", [(0, 0), (1, 0), (0, 1), (1, 1), (0.5, 0)])
def test_warp_of_a_ramp(spark, fx, fy):
    a = np.arange(30.0).reshape(2, 3, 5)
    got = array(stencil.taps(pixels(spark, a), constant_flow(spark, a.shape, float(fx), float(fy)), [(1, 0, 0)], "linear"), a.shape, "value")
    y, x = np.mgrid[:3, :5]
    want = np.where((y + fy <= 2) & (x + fx <= 4), 15 + (y + fy) * 5 + x + fx, np.nan)
    np.testing.assert_allclose(got[0], want)
    assert np.isnan(got[1]).all()


def test_smoothing_of_opposite_flows(spark):
    f = constant_flow(spark, (3, 3, 5), 1.0, 0.0)
    got = stencil.smooth_flow(f).where("t = 1").select("fx", "fy", "bx", "by").distinct().collect()
    assert {tuple(r) for r in got} == {(1.0, 0.0, -1.0, 0.0)}


@pytest.mark.parametrize("shift", [(0, 0), (0, 1), (0, -1), (1, 0), (-1, 0), (1, 1)])
def test_flow_of_a_shifted_blob(shift):
    y, x = np.mgrid[:10, :15]
    blob = kernels.to_8bit((49 - (x - 7.0) ** 2) * (20.25 - (y - 4.5) ** 2), 0, 49 * 20.25)
    f = kernels.pair_flow(blob, np.roll(blob, shift, (0, 1)))
    inside = (slice(3, 7), slice(4, 11))
    assert np.rint(np.median(f[1][inside])) == shift[0] and np.rint(np.median(f[0][inside])) == shift[1]
    assert np.rint(np.median(f[3][inside])) == -shift[0] and np.rint(np.median(f[2][inside])) == -shift[1]


def test_flow_of_a_smooth_field():
    a = kernels.gaussian(np.random.default_rng(0).random((120, 140)), 5)
    a = (a - a.min()) / (a.max() - a.min())
    f = kernels.pair_flow(a, np.roll(a, (3, -4), (0, 1)))
    assert abs(f[0][25:-25, 25:-25] + 4).max() < 0.05 and abs(f[1][25:-25, 25:-25] - 3).max() < 0.05


def test_flow_models():
    assert kernels.model("Farneback") is kernels.farneback
    with pytest.raises(NotImplementedError):
        kernels.model("DualTVL1")
    with pytest.raises(ValueError):
        kernels.model("other")


def test_optical_flow_of_frames(spark):
    a = kernels.gaussian(np.random.default_rng(1).random((60, 70)), 4) * 100
    cube = np.stack([np.roll(a, (k, k), (0, 1)) for k in (-1, 0, 1)])
    f = frames.optical_flow(pixels(spark, cube)).where("y between 15 and 45 and x between 15 and 55")
    r = f.groupBy("t").agg(*(F.avg(c).alias(c) for c in ("fx", "fy", "bx", "by"))).orderBy("t").collect()
    for row in r:
        assert all(abs(row[c] - v) < 0.1 for c, v in (("fx", 1), ("fy", 1), ("bx", -1), ("by", -1)))


def test_flow_frame_checks_columns(spark):
    with pytest.raises(ValueError):
        stencil.FlowFrame(spark.createDataFrame([(0, 0, 0, 1.0)], "t int, y int, x int, fx double"))
    f = stencil.FlowFrame(constant_flow(spark, (2, 2, 2)))
    assert f["t = 0"].flow.count() == 4


def test_watershed_mask(spark):
    a = np.zeros((1, 5, 5))
    a[:, 3:] = 1
    for distance, rows in ((1, 2), (2, 1), (3, 0)):
        m = array(morphology.watershed_mask(pixels(spark, a), distance), a.shape, "m")
        assert (m[0] == (np.arange(5) < rows)[:, None]).all()
    a[0, 2] = np.nan
    m = array(morphology.watershed_mask(pixels(spark, a), 1), a.shape, "m")
    assert m[0, 2].all() and not m[0, 3:].any()


def test_edge_field(spark):
    a = np.zeros((1, 5, 5))
    a[:, 3:] = 1
    a[:, :, 0] = np.nan
    e = array(stencil.edge_field(pixels(spark, a), constant_flow(spark, a.shape)), a.shape, "value")[0]
    assert (e[2, 1:] > 0).all() and (e[:2, 1:] == 0).all() and (e[3:, 1:] == -1).all() and np.isinf(e[:, 0]).all()


def test_slice_and_step_labels(spark):
    a = np.zeros((3, 4, 6), int)
    a[0, 1:3, 1:3] = 1
    a[1, 1:3, 1:3] = 1
    a[1, 1:3, 4:6] = 1
    a[2, 1:3, 1:3] = 2
    s = array(labels.slice_labels(pixels(spark, a, "label")), a.shape, "step_label")
    assert set(np.unique(s)) == {0, 1, 2, 3} and s[1, 1, 1] == s[1, 1, 4] == 2
    p = array(labels.split_components(pixels(spark, a, "label")), a.shape, "step_label")
    assert set(np.unique(p)) == {0, 1, 2, 3, 4} and p[1, 1, 1] == 2 and p[1, 1, 4] == 3


def test_slice_labels_without_background(spark):
    s = labels.slice_labels(pixels(spark, np.ones((2, 2, 2), int), "label"))
    assert {r["step_label"] for r in s.collect()} == {1, 2}


def test_filters_and_lengths(spark):
    a = np.zeros((4, 1, 3), int)
    a[0:3, 0, 0] = 5
    a[1, 0, 1] = 7
    a[[0, 3], 0, 2] = 9  # gaps count
    p = pixels(spark, a, "label")
    assert {r["label"]: r["length"] for r in labels.lengths(p).collect()} == {5: 3, 7: 1, 9: 4}
    kept = array(labels.filter_labels(p, 3), a.shape, "label")
    assert kept[0, 0, 0] == 1 and kept[1, 0, 1] == 0 and kept[0, 0, 2] == 2
    strict = array(labels.filter_labels(p, 3, strict=True), a.shape, "label")
    assert strict[0, 0, 0] == 0 and strict[0, 0, 2] == 1


def test_components_and_distance_against_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(60):
        m = rng.random((rng.integers(1, 9), rng.integers(1, 9))) < 0.55
        want, n = np.zeros(m.shape, int), 0
        for p in map(tuple, np.argwhere(m)):
            if want[p] == 0:
                n += 1
                todo = [p]
                while todo:
                    y, x = todo.pop()
                    if 0 <= y < m.shape[0] and 0 <= x < m.shape[1] and m[y, x] and want[y, x] == 0:
                        want[y, x] = n
                        todo += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
        assert (kernels.components(m) == want).all()
        points, d = np.argwhere(m), kernels.distance(m)[0]
        for p in np.ndindex(m.shape):
            assert d[p] == pytest.approx(np.sqrt(((points - p) ** 2).sum(axis=1)).min() if len(points) else np.inf)


def test_flood_against_a_plain_queue(spark):
    rng = np.random.default_rng(3)
    field = rng.permutation(2 * 5 * 6).reshape(2, 5, 6).astype(float)
    markers = np.zeros(field.shape, int)
    markers[0, 0, 0], markers[1, 4, 5], markers[0, 4, 0] = 1, 2, -1
    want, todo = markers.copy(), [(field[p], p) for p in map(tuple, np.argwhere(markers))]
    while todo:
        todo.sort()
        _, (t, y, x) = todo.pop(0)
        for q in ((t - 1, y, x), (t, y - 1, x), (t, y, x - 1), (t, y, x + 1), (t, y + 1, x), (t + 1, y, x)):
            if all(0 <= a < b for a, b in zip(q, field.shape, strict=True)) and want[q] == 0:
                want[q] = want[t, y, x]
                todo.append((field[q], q))
    got = flooding.watershed(constant_flow(spark, field.shape), pixels(spark, field), pixels(spark, markers, "label"))
    assert (array(got, field.shape, "label") == want).all()


def test_objects_follow_the_flow(spark):
    a = np.zeros((3, 5, 12), bool)
    for t in range(3):
        a[t, 1:3, 1 + 3 * t : 3 + 3 * t] = True
    m = pixels(spark, a, "m")
    still = tracking.flow_label(constant_flow(spark, a.shape), m, 0.0, 0)
    moving = tracking.flow_label(constant_flow(spark, a.shape, 3.0), m, 0.5, 1)
    assert still.agg(F.max("label")).first()[0] == 3 and moving.agg(F.max("label")).first()[0] == 1
    both = tracking.flow_label(constant_flow(spark, a.shape, 3.0), m, 0.5, 1, undirected=True)
    assert both.agg(F.max("label")).first()[0] == 1


def test_ordered_groups_are_directed():
    assert kernels.ordered_groups([1, 2, 3], {2: [1], 3: [2]}, {}) == {1: 1, 2: 2, 3: 3}
    assert kernels.ordered_groups([1, 2, 3], {1: [2], 2: [3]}, {}) == {1: 1, 2: 1, 3: 1}


def test_components_of_a_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "src long, dst long")
    assert {r["root"] for r in linking.components(e).collect()} == {0, 100}


def test_link_map(spark):
    rows = []
    for file, labels_at in (("a", {t: 3 for t in range(6)}), ("b", {t: 1 for t in range(2, 9)})):
        rows += [(file, t, y, x, v) for t, v in labels_at.items() for y in range(3) for x in range(3)]
    links = linking.link_map(spark.createDataFrame(rows, "file string, t int, y int, x int, label int")).collect()
    assert {(r["file"], r["label"]): r["global_label"] for r in links} == {("a", 3): 1, ("b", 1): 1}


def test_normalisation(spark):
    p = pixels(spark, np.array([[[0.0, 1.0, np.nan, 3.0]]]))
    assert [r["v"] for r in normalise.to_8bit(p, ["t"]).orderBy("x").collect()] == [0, 85, 127, 255]
    flat = normalise.linear_norm(pixels(spark, np.ones((1, 1, 3))), ["t"]).collect()
    assert {r["v"] for r in flat} == {0.0}
    with pytest.raises(ValueError):
        normalise.linearise(F.col("v"), 1.0, 1.0)
    with pytest.raises(ValueError):
        normalise.method("other")
    ranged = normalise.local_linear_norm(p, ["t"], size=3).orderBy("x").collect()
    assert ranged[0]["v"] == 0.0 and ranged[3]["v"] == 1.0


@pytest.mark.parametrize("lat,lon,want", [(1, 0, 0), (-1, 0, 180), (0, 1, 90), (0, -1, -90), (1, 1, 45)])
def test_azimuth_and_speed(spark, lat, lon, want):
    s = spark.createDataFrame([(1, 1, 0.0, 1.0, 0.0, 0.0), (1, 2, 100.0, 1.0, float(lat), float(lon))], "core long, step long, t double, area double, lat double, lon double")
    r = entities.core_properties(s).first()
    assert abs(r["core_propagation_direction"]) == pytest.approx(abs(want), abs=0.5)
    assert r["core_propagation_speed"] == pytest.approx(1112 * np.hypot(lat, lon), rel=0.01)


def test_geodesic(spark):
    c = lambda v: F.lit(float(v))
    r = spark.range(1).select(geo.geodesic(c(0), c(0), c(0), c(1)).alias("e"), geo.geodesic(c(0), c(0), c(1), c(0)).alias("n"), geo.geodesic(c(5), c(5), c(5), c(5)).alias("z")).first()
    assert r["e"] == pytest.approx(111.31949, abs=1e-4) and r["n"] == pytest.approx(110.57439, abs=1e-4) and r["z"] == pytest.approx(0, abs=1e-9)


def test_projection_round_trip(spark):
    lat, lon = F.lit(31.2), F.lit(-88.4)
    x, y = geo.geos_forward(lat, lon)
    a, b = geo.geos_inverse(x, y)
    r = spark.range(1).select(a.alias("a"), b.alias("b"), geo.geos_forward(F.lit(0.0), F.lit(100.0))[0].alias("beyond")).first()
    assert r["a"] == pytest.approx(31.2) and r["b"] == pytest.approx(-88.4) and r["beyond"] is None


def test_edges_and_bins(spark):
    g = regrid.edges(spark.createDataFrame([(0.0,), (1.0,), (3.0,)], "c double"))
    assert [(r["lo"], r["hi"]) for r in g.orderBy("i").collect()] == [(0.0, 0.5), (0.5, 2.0), (2.0, 3.0)]
    p = regrid.binned(spark.createDataFrame([(v,) for v in (-0.1, 0.0, 0.5, 3.0, 3.1)], "v double"), g, "v", "bin")
    assert sorted((r["v"], r["bin"]) for r in p.collect()) == [(0.0, 0), (0.5, 1), (3.0, 2)]


def test_asof(spark):
    left = spark.createDataFrame([(10.0,), (100.0,)], "s double")
    right = spark.createDataFrame([(8.0, "a"), (12.0, "b"), (300.0, "c")], "s double, k string")
    assert {(r["s"], r["k"]) for r in regrid.asof_nearest(left, right, 60.0).collect()} == {(10.0, "a"), (100.0, None)}


def test_file_names(spark):
    n = "detected_G16_S20180619_000000_E20180620_000000_X0_Y0.nc"
    s, e = files.span(F.lit(n))
    r = spark.range(1).select(s.cast("string").alias("s"), e.cast("string").alias("e")).first()
    assert (r["s"], r["e"]) == ("2018-06-19 00:00:00", "2018-06-20 00:00:00")
    t = spark.range(1).select(files.native_time(F.lit("MSG4-SEVI-MSG15-0100-NA-20180619121243.nat")).cast("string").alias("t")).first()["t"]
    assert t == "2018-06-19 12:12:43"


def test_listing(spark, tmp_path):
    for n in ("a.nat", "a.zip", "b.zip"):
        (tmp_path / n).write_bytes(b"x")
    got = files.prefer(files.listing(spark, str(tmp_path)))
    assert {r["name"] for r in got.collect()} == {"a.nat", "b.zip"}
    assert {(r["a"], r["b"]) for r in files.parameters(spark, a=[1, 2], b=["x"]).collect()} == {(1, "x"), (2, "x")}


def test_jobs(spark, tmp_path):
    from driftframe.plans import fixtures, jobs

    lab = fixtures.label(spark, "/root/testdata/sf0.001").withColumns({"area": F.lit(1.0), "bt": F.col("v")})
    lab.write.parquet(str(tmp_path / "in"))
    a = lambda *v: jobs.main(["--input", str(tmp_path / "in"), "--output", str(tmp_path / "out"), *v])
    a("statistics")
    steps = spark.read.parquet(str(tmp_path / "out" / "steps"))
    assert steps.count() == lab.where("label <> 0").select("t", "label").distinct().count() and "bt_mean" in steps.columns
    assert "core_bt_mean" in spark.read.parquet(str(tmp_path / "out" / "objects")).columns
    lab.where("v > 0.3").select("t", "y", "x", F.lit(2).alias("n")).write.parquet(str(tmp_path / "events"))
    a("validate", "--events", str(tmp_path / "events"), "--margin", "2", "--time-margin", "1", "--output", str(tmp_path / "val"))
    assert 0 <= spark.read.parquet(str(tmp_path / "val" / "summary")).first()["pod"] <= 1
    files_ = lab.withColumn("file", F.floor(F.col("t") / 9)).union(lab.where("t % 9 < 4 and t >= 9").withColumn("file", F.floor(F.col("t") / 9) - 1))
    assert jobs.link(files_.select("file", "t", "y", "x", "label")).where("label > 0").count() > 0


def test_residual_of_a_perfect_flow(spark):
    from driftframe.plans import jobs

    a = kernels.gaussian(np.random.default_rng(1).random((50, 60)), 4) * 100
    p = pixels(spark, np.stack([a, np.roll(a, 2, 1)]))
    r = jobs.residual(p, constant_flow(spark, (2, 50, 60), 2.0)).where("t = 0 and y between 15 and 35 and x between 15 and 45")
    assert r.agg(F.max("value")).first()[0] < 0.05


def plain_descent(v, marks):
    """Labels by descent and lowest passes, in a frame that stands still."""
    near = lambda p: [q for d in ((-1, 0, 0), (0, -1, 0), (0, 0, -1), (0, 0, 0), (0, 0, 1), (0, 1, 0), (1, 0, 0)) if (q := tuple(np.add(p, d))) in at]
    at = {p: v[p] for p in np.ndindex(v.shape)}

    def low(p):
        q = min(near(p), key=at.get)
        return p if q == p else low(q)

    ends = {p: low(p) for p in at}
    label = {}
    for p, e in ends.items():
        if marks[p]:
            label[e] = max(label.get(e, marks[p]), marks[p])
    while lost := [p for p in at if ends[p] not in label]:
        best = {}
        for p in lost:
            for q in near(p):
                if ends[q] in label:
                    step = (max(at[p], at[q]), label[ends[q]])
                    best[ends[p]] = min(best.get(ends[p], step), step)
        if not best:
            break
        label |= {e: b for e, (_, b) in best.items()}
    return np.array([label.get(ends[p], 0) for p in at]).reshape(v.shape)


def test_descent_against_brute_force(spark):
    rnd = np.random.default_rng(5)
    v, marks = rnd.permutation(72).reshape(3, 4, 6).astype(float), np.zeros((3, 4, 6), int)
    marks[0, 0, 0], marks[2, 3, 5] = 1, 2
    got = flooding.descent(constant_flow(spark, v.shape), pixels(spark, v), pixels(spark, marks, "label"))
    assert (array(got, v.shape, "label") == plain_descent(v, marks)).all()


def test_descent_over_blocks_without_a_row_for_each_tap(spark, monkeypatch):
    rnd, shape = np.random.default_rng(6), (19, 3, 4)
    v, marks = rnd.permutation(228).reshape(shape).astype(float), np.zeros(shape, int)
    v[:, 1, 1] = -np.arange(19)  # a way down through all blocks of steps
    marks[0, 0, 0], marks[18, 1, 1], marks[9, 2, 3] = 1, 2, -1
    monkeypatch.setattr(flooding, "taps", None)
    got = flooding.descent(constant_flow(spark, shape), pixels(spark, v), pixels(spark, marks, "label"))
    assert (array(got, shape, "label") == plain_descent(v, marks)).all()


def test_network_watershed_takes_all_steps(spark, monkeypatch):
    from driftframe.plans import fixtures, kernel_queries

    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(flooding, "descent", lambda flow, field, markers: field.join(flow, ["t", "y", "x"]).join(markers, ["t", "y", "x"]))
    assert kernel_queries.network_watershed(spark, sf).count() == fixtures.cube(spark, sf).count()


def test_watershed_query_floods_the_whole_cube(spark):
    from driftframe.plans import fixtures, kernel_queries

    sf = "/root/testdata/sf0.001"
    v, marks, flow = fixtures.cube(spark, sf).toPandas(), kernel_queries._markers(spark, sf).toPandas(), fixtures.flow(spark, sf).toPandas()
    shape = tuple(v[["t", "y", "x"]].max() + 1)

    def cube(df, name):
        a = np.zeros(shape)
        a[df["t"], df["y"], df["x"]] = df[name]
        return a

    f, b = (np.stack([cube(flow, f"{p}y"), cube(flow, f"{p}x")], axis=-1) for p in "fb")
    want = kernels.flood(-cube(v, "v").astype(np.float32), cube(marks, "label").astype(np.int32), np.ones(shape, bool), f, b)
    assert (array(kernel_queries.watershed(spark, sf), shape, "label") == want).all()


@pytest.mark.parametrize("move", [(0, 0), (0, 1), (1, 0), (0, -1), (-1, 0), (-1, -1)])
def test_inverse_search_to_a_twentieth(move):
    yy, xx = np.mgrid[:10, :15].astype(float)
    blob = (49 - (xx - 7) ** 2) * (20.25 - (yy - 4.5) ** 2)
    fx, fy, bx, by = kernels.pair_flow(blob, np.roll(blob, move, (0, 1)), "dis")
    assert max(np.abs(c - w).max() for c, w in ((fx, move[1]), (fy, move[0]), (bx, -move[1]), (by, -move[0]))) < 0.05


def test_inverse_search_over_several_levels():
    yy, xx = np.mgrid[:90, :120].astype(float)
    field = lambda y, x: 40 * np.sin(y / 7) + 30 * np.cos(x / 9) + 20 * np.sin((x + y) / 13)
    fx, fy, _, _ = kernels.pair_flow(field(yy, xx), field(yy - 4.5, xx + 6.25), "dis", vr_steps=1)
    inner = np.s_[30:-30, 30:-30]  # nearer the border, what leaves the frame tells
    assert np.abs(fx[inner] + 6.25).max() < 0.1 and np.abs(fy[inner] - 4.5).max() < 0.1


def test_flow_with_gaps_and_scales(spark):
    yy, xx = np.mgrid[:10, :15].astype(float)
    blob = (49 - (xx - 7) ** 2) * (20.25 - (yy - 4.5) ** 2)
    cube = np.stack([blob, np.roll(blob, 1, 1)])
    cube[1, 3, 4] = np.nan
    for scale in (None, "linear", "z_score", "local_linear"):
        f = frames.optical_flow(pixels(spark, cube), "dis", scale=scale).where("t = 0").toPandas()
        assert len(f) == 150 and (f["fx"] - 1).abs().median() < 0.1
    part = pixels(spark, cube).where("t = 0 or x > 2")  # frames of different extent
    f = frames.optical_flow(part, "dis").where("t = 0 and x > 4").toPandas()
    assert (f["fx"] - 1).abs().median() < 0.1


@pytest.mark.parametrize("kind", ["int", "bigint", "string"])
def test_closure_of_long_chains_takes_few_rounds(spark, monkeypatch, kind):
    rounds = []
    keep = linking.stored
    monkeypatch.setattr(linking, "stored", lambda df: rounds.append(1) or keep(df))
    edges = [(i, i + 5) for i in range(600) if i % 150 > 4] + [(70_000, 70_001), (70_001, 599), (80_000, 80_000)]
    if kind == "string":
        edges = [(f"{a:05d}", f"{b:05d}") for a, b in edges[-40:]]
    got = {r.node: r.root for r in linking.components(spark.createDataFrame(edges, f"src {kind}, dst {kind}")).collect()}
    near = {n: {n} for e in edges for n in e}
    for a, b in edges:
        near[a].add(b), near[b].add(a)
    want = {}
    for n in sorted(near):
        todo = [] if n in want else [n]
        while todo:
            if (m := todo.pop()) not in want:
                want[m] = n
                todo += near[m]
    assert got == want
    assert kind == "string" or len(rounds) <= 5


def test_steps_are_not_dealt_out_by_a_few_objects(spark):
    steps = spark.range(4000).select((F.col("id") % 3).alias("anvil"), F.col("id").alias("step"), (F.col("id") % 50).alias("core"))
    ids = lambda c, n: spark.range(n).select(F.col("id").alias(c))
    own = entities.Objects(ids("core", 51), ids("anvil", 4), steps.select("core", "step"), steps.select("anvil", "step"), steps.select("anvil", "step").where("anvil > 0"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = own.without_orphans()
        assert "SortMergeJoin" not in got.thick_anvil_step._jdf.queryExecution().executedPlan().toString()
        assert sorted(r["anvil"] for r in got.anvil.collect()) == [1, 2] and got.core.count() == 50
        assert {r["anvil"] for r in got.thick_anvil_step.collect()} == {1, 2} and got.thick_anvil_step.count() == 2666
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
