"""Detection, linking and sampling against plain loops over small cubes."""

import math

import numpy as np
import pytest

from driftframe.operators import detection, flooding, kernels, stencil, tiles, tracking, validation

CROSS = [(0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)]


def table(spark, cube, name="v", kind="double"):
    rows = [(*map(int, p), None if isinstance(cube[p], float) and math.isnan(cube[p]) else cube[p].item()) for p in np.ndindex(cube.shape)]
    return spark.createDataFrame(rows, f"t int, y int, x int, {name} {kind}")


def flow_table(spark, f, b):
    rows = [(*map(int, p), *map(float, (f[0][p], f[1][p], b[0][p], b[1][p]))) for p in np.ndindex(f[0].shape)]
    return spark.createDataFrame(rows, "t int, y int, x int, fx double, fy double, bx double, by double")


def cube_of(df, name, shape, fill=np.nan):
    out = np.full(shape, fill, dtype=float)
    for r in df.collect():
        out[r["t"], r["y"], r["x"]] = np.nan if r[name] is None else r[name]
    return out


def kernel(d, method):
    d = abs(d)
    if method == "linear":
        return max(0.0, 1 - d)
    if method == "cubic":
        return 1.25 * d**3 - 2.25 * d**2 + 1 if d <= 1 else -0.75 * (d**3 - 5 * d**2 + 8 * d - 4) if d < 2 else 0.0
    return 1.0 if d == 0 else 0.0 if d == int(d) or d >= 4 else math.sin(math.pi * d) * math.sin(math.pi * d / 4) * 4 / (math.pi * d) ** 2


def sample(frame, y, x, method):
    if method == "nearest":
        i, j = int(np.rint(y)), int(np.rint(x))
        return frame[i, j] if 0 <= i < frame.shape[0] and 0 <= j < frame.shape[1] else np.nan
    reach, total, weight = {"linear": 1, "cubic": 2, "lanczos": 4}[method], 0.0, 0.0
    for i in range(math.floor(y) - reach + 1, math.floor(y) + reach + 1):
        for j in range(math.floor(x) - reach + 1, math.floor(x) + reach + 1):
            w = kernel(y - i, method) * kernel(x - j, method)
            if abs(w) > 1e-13:
                inside = 0 <= i < frame.shape[0] and 0 <= j < frame.shape[1]
                total, weight = total + w * (frame[i, j] if inside else np.nan), weight + w
    return total / weight


def along(cube, flow, p, dt, method):
    t, y, x = p
    if not 0 <= t + dt < len(cube):
        return np.nan
    fx, fy = flow[0 if dt > 0 else 1]
    return sample(cube[t + dt], y + fy[p], x + fx[p], method)


def diffed(cube, flow, method):
    out = np.full(cube.shape, np.nan)
    for p in np.ndindex(cube.shape):
        got = [d for d in (along(cube, flow, p, 1, method) - cube[p], cube[p] - along(cube, flow, p, -1, method)) if not math.isnan(d)]
        out[p] = np.nan if math.isnan(cube[p]) else sum(got) / max(len(got), 1)
    return out


def crossed(cube, reduce, outside):
    out = np.empty(cube.shape, cube.dtype)
    for t, y, x in np.ndindex(cube.shape):
        near = [cube[t, y + i, x + j] if 0 <= y + i < cube.shape[1] and 0 <= x + j < cube.shape[2] else outside for i, j in CROSS]
        out[t, y, x] = reduce(near)
    return out


def opened(m):
    return crossed(crossed(m, all, False), any, False)


def grown(cube, flow, method):
    def mean(near):
        near = [v for v in near if not math.isnan(v)]
        return sum(near) / len(near) if near else np.nan

    g = crossed(diffed(cube, flow, method), mean, np.nan)
    return np.where(np.isnan(cube), np.nan, g)


def filtered(flow, bt, wvd, swd):
    each = lambda f, down: np.stack([kernels.curvature(a, 2.0, 0.0, down) | (np.asarray(kernels.peak_filter(a, 0.5, 10, down)) > 0) for a in f])
    m = each(bt, False) | each(wvd, True)
    wide = m.copy()
    for p in np.ndindex(m.shape):
        for dt in (-1, 1):
            v = along(m.astype(float), flow, p, dt, "nearest")
            wide[p] |= v > 0.5
    m = opened(np.stack([kernels.fill_holes(a) for a in wide]))
    return m * (1 - np.clip((swd - 2.5) / 5, 0, 1))


def linked(flow, m, overlap, absolute):
    """Regions of each step, linked along the flow in the order of discovery."""
    steps, start = np.zeros(m.shape, int), 0
    for t, a in enumerate(m):
        c = np.asarray(kernels.components(a, False))
        steps[t] = np.where(c > 0, c + start, 0)
        start += c.max()
    n, size = {}, np.bincount(steps.ravel(), minlength=start + 1)
    for p in np.ndindex(m.shape):
        for k, dt in enumerate((1, -1)):
            v = along(steps.astype(float), flow, p, dt, "nearest")
            if steps[p] and v > 0:
                key = (k, int(steps[p]), int(v))
                n[key] = n.get(key, 0) + 1
    links = ({}, {})
    for (k, a, b), c in n.items():
        if c > absolute and c >= overlap * min(size[a], size[b]):
            links[k].setdefault(a, []).append(b)
    number = {}
    for seed in range(1, start + 1):
        if seed not in number:
            number[seed] = new = max(number.values(), default=0) + 1
            queue = [seed]
            for a in queue:
                for side in links:
                    for b in sorted(side.get(a, ())):
                        if b not in number:
                            number[b] = new
                            queue.append(b)
    return np.array([0, *(number[i] for i in range(1, start + 1))])[steps]


def renumbered(cube, keep):
    kept = {v: i + 1 for i, v in enumerate(sorted(v for v in np.unique(cube) if v and keep(v)))}
    return np.array([[[kept.get(v, 0) for v in row] for row in frame] for frame in cube])


@pytest.fixture(scope="module")
def scene():
    rng = np.random.default_rng(7)
    shape = (5, 14, 16)
    yy, xx = np.mgrid[: shape[1], : shape[2]]
    bt = np.stack([-6 * t * np.exp(-((yy - 6 - 0.5 * t) ** 2 + (xx - 5 - t) ** 2) / 8) - 3 * t * np.exp(-((yy - 10) ** 2 + (xx - 12) ** 2) / 4) for t in range(5)]) + 0.3 * rng.normal(size=shape)
    wvd = -0.5 * bt + 0.2 * rng.normal(size=shape)
    swd = 3 + rng.normal(size=shape)
    bt[2, 3, 4] = np.nan
    f = (np.where(xx < 9, 1.0, 0.25) * np.ones(shape), np.where(xx < 9, 0.5, -0.25) * np.ones(shape))
    return bt, wvd, swd, (f, (-f[0], -f[1]))


@pytest.mark.parametrize("method", ["linear", "cubic", "lanczos"])
def test_sampling_along_the_flow(spark, scene, method):
    bt, _, _, flow = scene
    got = stencil.taps(table(spark, bt), flow_table(spark, *flow), [(1, 0, 0), (-1, 0, 0)], method)
    for tap, dt in enumerate((1, -1)):
        want = np.array([along(bt, flow, p, dt, method) for p in np.ndindex(bt.shape)]).reshape(bt.shape)
        assert np.allclose(cube_of(got.where(f"tap = {tap}"), "value", bt.shape), want, equal_nan=True, atol=1e-9)
    assert np.isfinite(want).any()


def test_growth_and_filters(spark, scene):
    bt, wvd, swd, flow = scene
    f = flow_table(spark, *flow)
    whole = np.nan_to_num(bt)
    assert np.allclose(cube_of(stencil.growth_rate(table(spark, bt), f, "cubic"), "value", bt.shape), grown(bt, flow, "cubic"), equal_nan=True)
    got = cube_of(detection.combined_filter(f, table(spark, whole), table(spark, wvd), table(spark, swd)), "f", bt.shape)
    assert np.allclose(got, filtered(flow, whole, wvd, swd)) and 0 < (got > 0).mean() < 1


def test_directed_links(spark):
    rng = np.random.default_rng(1)
    m = rng.random((6, 12, 12)) < 0.45
    f = tuple(rng.integers(-1, 2, m.shape).astype(float) for _ in range(2))
    flow = (f, (-f[0], -f[1]))
    got = cube_of(tracking.flow_label(flow_table(spark, *flow), table(spark, m, "m", "boolean"), 0.1, 1), "label", m.shape)
    want = linked(flow, m, 0.1, 1)
    assert (got == want).all() and want.max() > 5


@pytest.mark.parametrize("least", [0.4, 50.0])
def test_cores(spark, scene, least):
    bt, wvd, swd, flow = scene
    bt = np.nan_to_num(bt)
    got = detection.detect_cores(flow_table(spark, *flow), table(spark, bt), table(spark, wvd), table(spark, swd), 0.1, 0.05, 0.1, 1, min_length=1, min_wvd=0.2, min_cooling=least)
    f = filtered(flow, bt, wvd, swd)
    m = opened((grown(-bt, flow, "cubic") * f > 0.1) | (grown(wvd, flow, "cubic") * f > 0.05))
    cores = linked(flow, m, 0.1, 1)

    def steps(v):
        return sorted({p[0] for p in np.argwhere(cores == v)})

    def cools(v):
        means = [bt[t][cores[t] == v].mean() for t in steps(v)]
        rates = [(a - b) / (s - r) for a, b, r, s in zip(means, means[1:], steps(v), steps(v)[1:], strict=False)]
        return max(rates, default=0) >= least

    want = renumbered(cores, lambda v: steps(v)[-1] - steps(v)[0] + 1 > 1 and (wvd[cores == v] > 0.2).any() and cools(v))
    assert (cube_of(got, "label", bt.shape) == want).all() and cores.max() > 0 and (want.max() > 0) == (least < 1)


def smooth(cube, flow):
    d, out = diffed(cube, flow, "linear"), np.empty(cube.shape)
    for p in np.ndindex(cube.shape):
        near = [v for v in (along(d, flow, p, -1, "linear"), d[p], along(d, flow, p, 1, "linear")) if not math.isnan(v)]
        out[p] = sum(near) / len(near)
    return out


def test_growth_markers(spark, scene):
    bt, wvd, _, flow = scene
    bt, f = np.nan_to_num(bt), flow_table(spark, *flow)
    w, b = smooth(wvd, flow), smooth(bt, flow)
    down, up = (np.stack([kernels.curvature(a, 2.0, 0.0, d) for a in c]) for c, d in ((wvd, True), (bt, False)))
    length = lambda c, v: np.ptp(np.argwhere(c == v)[:, 0]) + 1

    least = crossed(w, lambda n: min(v for v in n if not math.isnan(v)), np.nan)
    g = crossed(least, lambda n: max(v for v in n if not math.isnan(v)), np.nan) * down
    found = linked(flow, opened(g >= 0.2), 0.0, 1)
    got = detection.growth_markers(f, table(spark, wvd), 0.2, 0.4, -5.0, 2)
    assert np.allclose(cube_of(got[0], "value", wvd.shape), w)
    want = renumbered(found, lambda v: length(found, v) >= 2 and (g[found == v] >= 0.4).any() and (wvd[found == v] >= -5).any())
    assert (cube_of(got[1], "label", wvd.shape) == want).all() and want.max() > 0

    found = linked(flow, opened((w * down >= 0.2) | (b * up <= -0.2)), 0.5, 1)
    got = detection.growth_markers_multichannel(f, table(spark, wvd), table(spark, bt), 0.5, 1, 0.0, 2, 0.2, 0.4, -5.0)
    want = renumbered(found, lambda v: length(found, v) >= 2 and all(c[found == v].any() for c in (w >= 0.4, b <= -0.4, wvd > -5)))
    assert (cube_of(got[2], "label", wvd.shape) == want).all() and want.max() > 0


@pytest.mark.parametrize("literal", [True, False])
def test_edge_watershed(spark, scene, literal):
    _, wvd, _, flow = scene
    flow = tuple(tuple(np.rint(c) for c in side) for side in flow)
    marks = (wvd > 6) * (1 + (np.arange(16) > 9))
    field = np.where(marks != 0, 4.0, np.clip(wvd, 0.0, 4.0))
    back = field == 0
    out = np.ones_like(back)
    for t, y, x in np.ndindex(back.shape):
        out[t, y, x] = all(back[t, i, j] for i in range(max(y - 1, 0), min(y + 2, 14)) for j in range(max(x - 1, 0), min(x + 2, 16)))
    weight = {-1: 1, 0: 2, 1: 1}
    edges = np.zeros(field.shape)
    for p in np.ndindex(field.shape):
        total = [0.0, 0.0, 0.0]
        for o in np.ndindex(3, 3, 3):
            o = tuple(k - 1 for k in o)
            t, y, x = p[0] + o[0], p[1] + o[1], p[2] + o[2]
            if o[0]:
                fx, fy = flow[0 if o[0] > 0 else 1]
                y, x = int(y + fy[p]), int(x + fx[p])
            if 0 <= t < 5 and 0 <= y < 14 and 0 <= x < 16:
                for k in range(3):
                    total[k] += (field[t, y, x] - field[p]) * o[k] * weight[o[(k + 1) % 3]] * weight[o[(k + 2) % 3]]
        edges[p] = math.sqrt(sum(v * v for v in total))
    pairs = [np.stack([side[1], side[0]], axis=-1) for side in flow]
    want = kernels.flood(edges.astype(np.float32), marks.astype(np.int32), out if literal else ~out, *pairs)
    want = want * opened(want != 0)
    got = detection.edge_watershed(flow_table(spark, *flow), table(spark, wvd), table(spark, marks.astype(int), "label", "int"), 4.0, 0.0, 1, literal)
    assert (cube_of(got, "label", wvd.shape) == want).all() and (want > 0).any()


def test_distances(spark):
    rng = np.random.default_rng(3)
    marks = (rng.random((5, 9, 8)) < 0.02) * rng.integers(1, 5, (5, 9, 8))
    m = table(spark, marks, "label", "int")
    at = np.argwhere(marks)
    for got, far in (
        (validation.ellipse_distance(m, 2, 6), lambda p: math.sqrt(((at - p) ** 2 * [9, 1, 1]).sum(axis=1).min())),
        (validation.cylinder_distance(m, 1, True), lambda p: min((math.hypot(*(q - p)[1:]) for q in at if abs(q[0] - p[0]) <= 1), default=np.nan)),
    ):
        want = np.array([far(np.array(p)) for p in np.ndindex(marks.shape)]).reshape(marks.shape)
        v, near = cube_of(got, "v", marks.shape), cube_of(got, "nearest", marks.shape)
        assert np.allclose(v, want, equal_nan=True)
        for p in np.ndindex(marks.shape):
            assert math.isnan(near[p]) if math.isnan(want[p]) else any(marks[tuple(q)] == near[p] for q in at)


@pytest.mark.parametrize("method", ["nearest", "cubic"])
def test_small_tiles_give_the_same(spark, scene, method):
    bt, _, _, flow = scene
    t, f = table(spark, bt), flow_table(spark, *flow)
    for one in (tiles.diff, tiles.growth, tiles.average, lambda tile: tiles.sobel(tile, "uphill")):
        whole, small = (cube_of(tiles.moving(t, f, one, method, tile=n), "value", bt.shape) for n in (512, 4))
        assert np.allclose(whole, small, equal_nan=True) and np.isfinite(whole).any()


@pytest.mark.parametrize("share", [0.02, 0.5, 0.8])
def test_regions_flood_as_the_whole(spark, share):
    rng = np.random.default_rng(int(share * 100))
    shape = (5, 11, 13)
    field = rng.integers(0, 6, shape).astype(float)
    marks = np.where(rng.random(shape) < share, rng.integers(-1, 4, shape), 0)
    allowed = rng.random(shape) < 0.9
    f, b = (tuple(rng.choice([-1.0, -0.5, 0.0, 0.5, 1.5], shape) for _ in range(2)) for _ in range(2))
    args = flow_table(spark, f, b), table(spark, field), table(spark, marks, "label", "int"), table(spark, allowed, "m", "boolean")
    want = kernels.flood(field.astype(np.float32), marks.astype(np.int32), allowed, *(np.stack([v[1], v[0]], axis=-1) for v in (f, b)))
    assert (cube_of(flooding.watershed(*args), "label", shape) == want).all()


def test_lanczos_taps_have_a_small_plan(spark, scene):
    bt, _, _, flow = scene
    for border in ("constant", "reflect"):
        got = stencil.taps(table(spark, bt), flow_table(spark, *flow), [(1, 0, 0)], "lanczos", border=border)
        assert len(got._jdf.queryExecution().optimizedPlan().toString()) < 100_000
    own = np.array([along(bt, flow, p, 1, "lanczos") for p in np.ndindex(bt.shape)]).reshape(bt.shape)
    both = cube_of(got, "value", bt.shape)[np.isfinite(own)], own[np.isfinite(own)]
    assert np.allclose(*both, atol=1e-9) and len(own[np.isfinite(own)])


def test_ellipse_distance_over_many_steps_and_incomplete_ones(spark):
    rng = np.random.default_rng(4)
    marks = (rng.random((70, 4, 9)) < 0.004) * rng.integers(1, 5, (70, 4, 9))
    marks[69, 1, 3] = 2
    t = table(spark, marks, "label", "int").where("t < 69 or y < 2")
    at = np.argwhere(marks)
    at = at[(at[:, 0] < 69) | (at[:, 1] < 2)]
    got = validation.ellipse_distance(t, 3, 6)
    assert "array_min" not in got._jdf.queryExecution().optimizedPlan().toString()
    rows = got.collect()
    assert len(rows) == t.count()
    for r in rows:
        far = ((at - (r.t, r.y, r.x)) ** 2 * [4, 1, 1]).sum(axis=1)
        assert math.isclose(r.v, math.sqrt(far.min())) and r.nearest in {marks[tuple(p)] for p in at[far == far.min()]}


def test_carried_distances_of_any_columns():
    rng = np.random.default_rng(5)
    for share in (0.0, 0.05, 1.0):
        column = np.sort(rng.integers(0, 6, 300))
        t = np.concatenate([np.sort(rng.integers(0, 200, (column == c).sum())) for c in range(6)])
        square = np.where(rng.random(300) < share, rng.integers(0, 40, 300), np.nan)
        v, own = kernels.carried(column, t, square, 2.0)
        for i in range(300):
            far = np.where((column == column[i]) & np.isfinite(square), square + (2.0 * (t - t[i])) ** 2, np.inf)
            assert v[i] == math.sqrt(far.min()) and own[i] == (np.argmin(far) if np.isfinite(far.min()) else -1)
    assert [len(k) for k in kernels.carried(*(np.zeros(0, int),) * 2, np.zeros(0), 1.0)] == [0, 0]


def test_combined_filter_led_along_the_flow_needs_no_row_for_each_tap(spark):
    """The mask of both channels meets the steps beside it on tiles: no rows are made of taps."""
    from driftframe.plans import fixtures

    c = fixtures.cube(spark, "/root/testdata/sf0.001")
    plan = detection.combined_filter(fixtures.flow(spark, "/root/testdata/sf0.001"), c)._jdf.queryExecution().executedPlan().toString()
    assert "max(coalesce" not in plan
