"""Basins joined over their passes against a plain version that takes the passes one by one from the lowest."""

import heapq
import tracemalloc

import numpy as np
import pytest

from driftframe.operators import flooding, kernels, tiles


def plain_basins(v, marks, vectors, allowed=None):
    """Labels of a cube: steepest descent, then passes in the order of (height, smaller number, larger number)."""
    nt, h, w = v.shape
    free = np.ones(v.shape, bool) if allowed is None else allowed
    at = lambda p: (p[0] * h + p[1]) * w + p[2]

    def led(t, y, x):
        fx, fy, bx, by = (int(np.rint(c[t, y, x])) for c in vectors)
        near = [(t - 1, y + by, x + bx), (t + 1, y + fy, x + fx), (t, y - 1, x), (t, y + 1, x), (t, y, x - 1), (t, y, x + 1)]
        return [q for q in near if 0 <= q[0] < nt and 0 <= q[1] < h and 0 <= q[2] < w and free[q]]

    value = lambda p: (v[p] if np.isfinite(v[p]) else np.inf, at(p))

    def end(p):
        while not marks[p]:
            q = min([*led(*p), p], key=value)
            if value(q) >= value(p):
                break
            p = q
        return int(marks[p]) - flooding.MARKED if marks[p] else at(p)

    own = [tuple(map(int, p)) for p in np.argwhere(free)]
    node = {p: end(p) for p in own}
    edges = {}
    for p in own:
        for q in led(*p):
            a, b = sorted((node[p], node[q]))
            if a != b and not (a < 0 and b < 0):
                edges[a, b] = min(edges.get((a, b), np.inf), max(value(p)[0], value(q)[0]))
    tree = {n: n for n in node.values()}

    def find(n):
        while tree[n] != n:
            n = tree[n]
        return n

    for _, a, b in sorted((height, a, b) for (a, b), height in edges.items()):
        a, b = find(a), find(b)
        if a != b and not (a < 0 and b < 0):
            tree[max(a, b)] = min(a, b)  # a marker's number is below all others
    out = np.zeros(v.shape, int)
    for p in own:
        n = find(node[p])
        out[p] = n + flooding.MARKED if n < 0 else 0
    return out


def table(spark, columns):
    names = list(columns)
    shape = columns[names[0]].shape
    rows = [(*map(int, p), *(None if isinstance(columns[n][p], float) and np.isnan(columns[n][p]) else columns[n][p].item() for n in names)) for p in np.ndindex(shape)]
    kinds = {"f": "double", "i": "int", "b": "boolean"}
    return spark.createDataFrame(rows, "t int, y int, x int, " + ", ".join(f"{n} {kinds[columns[n].dtype.kind]}" for n in names))


def cube_of(df, shape):
    out = np.full(shape, -99)
    for r in df.collect():
        out[r["t"], r["y"], r["x"]] = r["label"]
    return out


@pytest.mark.parametrize("case", ["plain", "ties", "holes", "few"])
def test_basins_against_passes_in_order(spark, case):
    rng, shape = np.random.default_rng(["plain", "ties", "holes", "few"].index(case)), (3, 9, 11)
    v = rng.normal(size=shape)
    vectors = tuple(rng.integers(-1, 2, shape).astype(float) for _ in range(4))
    marks = np.where(rng.random(shape) < (0.01 if case == "few" else 0.06), rng.integers(-2, 4, shape), 0)
    allowed = None
    if case == "ties":
        v = np.round(v)  # plateaus, and many passes of one height
    if case == "holes":
        v[rng.random(shape) < 0.1] = np.nan
        allowed = (rng.random(shape) < 0.7) | (marks != 0)
    flow = table(spark, dict(zip(("fx", "fy", "bx", "by"), vectors, strict=True)))
    m = None if allowed is None else table(spark, {"m": allowed})
    got = cube_of(flooding.basins(flow, table(spark, {"v": v}), table(spark, {"label": marks}), m), shape)
    assert (got == plain_basins(v, marks, vectors, allowed)).all()


def test_basins_over_blocks_without_a_row_for_each_link(spark, monkeypatch):
    rng, shape = np.random.default_rng(9), (2 * tiles.STEPS + 3, 4, 5)
    v, vectors = np.round(rng.normal(size=shape), 1), tuple(rng.integers(-1, 2, shape).astype(float) for _ in range(4))
    v[:, 1, 2] = -np.arange(shape[0])  # a way down through all blocks of steps
    for c in vectors:
        c[:, 1, 2] = 0
    marks = np.where(rng.random(shape) < 0.02, rng.integers(1, 4, shape), 0)
    monkeypatch.setattr(flooding, "taps", None)
    flow = table(spark, dict(zip(("fx", "fy", "bx", "by"), vectors, strict=True)))
    got = cube_of(flooding.basins(flow, table(spark, {"v": v}), table(spark, {"label": marks})), shape)
    assert (got == plain_basins(v, marks, vectors)).all()


def test_basins_without_markers_or_pixels(spark):
    v, zero = np.arange(12.0).reshape(1, 3, 4), np.zeros((1, 3, 4))
    flow, field = table(spark, dict.fromkeys(("fx", "fy", "bx", "by"), zero)), table(spark, {"v": v})
    none = table(spark, {"label": zero.astype(int)})
    assert (cube_of(flooding.basins(flow, field, none), v.shape) == 0).all()
    assert flooding.basins(flow.limit(0), field.limit(0), none.limit(0)).count() == 0


def plain_flood(field, markers, allowed, forward, backward):
    """The flood with a queue of tuples, pixel by pixel."""
    out, age = markers.astype(np.int32).copy(), 0
    heap = [(field[p], 0, i, p) for i, p in enumerate(map(tuple, np.argwhere(markers != 0)))]
    heapq.heapify(heap)
    f, b = np.rint(forward).astype(int), np.rint(backward).astype(int)
    while heap:
        *_, (t, y, x) = heapq.heappop(heap)
        for q in ((t - 1, y + b[t, y, x, 0], x + b[t, y, x, 1]), (t, y - 1, x), (t, y, x - 1), (t, y, x + 1), (t, y + 1, x), (t + 1, y + f[t, y, x, 0], x + f[t, y, x, 1])):
            if all(0 <= i < n for i, n in zip(q, field.shape, strict=True)) and allowed[q] and out[q] == 0:
                age += 1
                out[q] = out[t, y, x]
                heapq.heappush(heap, (field[q], age, 0, q))
    return out


def test_compact_flood_against_tuples_on_plateaus_and_gaps():
    rng = np.random.default_rng(1)
    for case in range(60):
        shape = tuple(rng.integers(1, 9, 3))
        v = rng.normal(size=shape).astype(np.float32)
        v = np.round(v) if case % 3 == 0 else v  # with both zeros
        v[rng.random(shape) < 0.1 * (case % 2)] = np.inf
        marks = np.where(rng.random(shape) < 0.1, rng.integers(-2, 4, shape), 0)
        given = v, marks, rng.random(shape) < 0.8, *(rng.normal(scale=1.5, size=(*shape, 2)) for _ in "fb")
        assert (kernels.flood(*given) == plain_flood(*given)).all()


def test_flood_of_an_open_field_takes_few_bytes_a_pixel():
    """Tuples in a queue and wide arrays took over 500 bytes a pixel."""
    shape = (60, 20, 64)
    rng = np.random.default_rng(2)
    v = rng.normal(size=shape).astype(np.float32)
    given = v, np.where(v < -2.2, 1, 0).astype(np.int32), np.ones(shape, bool), np.zeros((*shape, 2), np.int8), np.zeros((*shape, 2), np.int8)
    tracemalloc.start()
    kernels.flood(*given)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 60 * v.size
