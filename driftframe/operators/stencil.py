"""Stencils in the moving frame of a flow field, as plans over pixel tables.

A tap of pixel (t, y, x) with offset (dt, dy, dx) samples frame t + dt at (y + fy + dy, x + fx + dx), where the
vector is the pixel's forward one for dt = 1, its backward one for dt = -1 and zero for dt = 0. Same-step and
nearest taps are one equi-join on integer coordinates; others run on tiles, but for those at borders that bring samples
back, which are a join on the 4, 16 or 64 pixels around with weights.
Joins and the aggregation that follows hash on coordinates, so work spreads evenly over frames. The stencils that
detection is made of (differences, means along the flow, Sobel, least taps) run on tiles instead, see ``tiles``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftframe.operators import tiles

KEY = ["t", "y", "x"]
Offset = tuple[int, int, int]


def full(connectivity: int = 3) -> list[Offset]:
    """Offsets of the 3 x 3 x 3 cube with at most ``connectivity`` non-zero parts, backward plane first and
    row-major inside a plane."""
    return [(t, y, x) for t in (-1, 0, 1) for y in (-1, 0, 1) for x in (-1, 0, 1) if abs(t) + abs(y) + abs(x) <= connectivity]


CROSS = [(0, y, x) for y in (-1, 0, 1) for x in (-1, 0, 1) if abs(y) + abs(x) <= 1]


def _vector(dt: Column, axis: str) -> Column:
    return F.when(dt == 1, F.col(f"f{axis}")).when(dt == -1, F.col(f"b{axis}")).otherwise(F.lit(0.0))


#: Shape of the cubic kernel (its slope at distance 1) and reach of the Lanczos kernel.
CUBIC, LANCZOS = -0.75, 4


def _weights(a: Column, method: str) -> list[tuple[int, Column]]:
    """Offsets of the pixels on one axis that make up a sample ``a`` beyond a pixel, with their weights; those of Lanczos
    are still to be divided by their sum."""
    if method == "linear":
        return [(0, 1 - a), (1, a)]
    if method == "cubic":
        near = lambda d: ((CUBIC + 2) * d - (CUBIC + 3)) * d * d + 1
        far = lambda d: ((CUBIC * d - 5 * CUBIC) * d + 8 * CUBIC) * d - 4 * CUBIC
        return [(-1, far(a + 1)), (0, near(a)), (1, near(1 - a)), (2, far(2 - a))]

    def windowed(i: int) -> Column:
        d = F.pi() * (a - i)
        return F.when(a == float(i), F.lit(1.0)).when(F.floor(a) == a, F.lit(0.0)).otherwise(F.sin(d) * F.sin(d / LANCZOS) * LANCZOS / (d * d))

    return [(i, windowed(i)) for i in range(1 - LANCZOS, LANCZOS + 1)]


def _bordered(at: Column, low: int, n: int, border: str) -> Column:
    """A coordinate of an axis of ``n`` pixels from ``low`` on, brought inside: the last pixel goes on (nearest), the
    axis is mirrored about its edge (reflect) or its last pixel (mirror), or starts again (wrap)."""
    i = at - low
    if border == "nearest":
        inside = F.least(F.greatest(i, F.lit(0)), F.lit(n - 1))
    elif border == "wrap":
        inside = F.pmod(i, F.lit(n))
    elif border == "reflect":
        m = F.pmod(i, F.lit(2 * n))
        inside = F.least(m, 2 * n - 1 - m)
    else:
        m = F.pmod(i, F.lit(max(2 * n - 2, 1)))
        inside = F.least(m, F.abs(2 * n - 2 - m))
    return (inside + low).cast("int")


METHODS = ("nearest", "linear", "cubic", "lanczos")
BORDERS = ("constant", "nearest", "reflect", "mirror", "wrap")


def taps(data: DataFrame, flow: DataFrame | None, offsets: Sequence[Offset], method: str = "nearest", value: str = "v", border: str = "constant") -> DataFrame:
    """``t, y, x, tap, value``: one row for each pixel and offset, NULL where the sample lies outside the data or
    (but for nearest) a missing value has a weight other than 0. ``tap`` numbers the offsets as given. Other borders
    than constant bring samples outside the box of the data back into it."""
    if method not in METHODS:
        raise ValueError(f"method is one of {METHODS}")
    if border not in BORDERS:
        raise ValueError(f"border is one of {BORDERS}")
    own = data.select(*KEY)
    if flow is not None:
        own = own.join(flow.select(*KEY, "fx", "fy", "bx", "by"), KEY)
    elif any(o[0] for o in offsets):
        raise ValueError("offsets in time need a flow")
    if method != "nearest" and border == "constant" and flow is not None and all(abs(o[0]) <= 1 for o in offsets):
        return tiles.taps(data, flow, offsets, method, value)
    fit = lambda c, axis: c
    if border != "constant":
        box = data.agg(*(f(c).alias(f"{k}{c}") for c in "yx" for k, f in (("lo", F.min), ("hi", F.max)))).first()
        if box["loy"] is not None:
            fit = lambda c, axis: _bordered(c, int(box[f"lo{axis}"]), int(box[f"hi{axis}"] - box[f"lo{axis}"]) + 1, border)
    table = F.array(*(F.struct(F.lit(i).alias("tap"), *(F.lit(v).alias(n) for n, v in zip(("dt", "dy", "dx"), o, strict=True))) for i, o in enumerate(offsets)))
    each = own.withColumn("o", F.explode(table)).select("*", "o.*").drop("o")
    source = data.select(F.col("t").alias("s_t"), F.col("y").alias("s_y"), F.col("x").alias("s_x"), F.col(value).alias("s_v"))
    zero = flow is None
    py = F.col("y") + F.col("dy") + (F.lit(0.0) if zero else _vector(F.col("dt"), "y"))
    px = F.col("x") + F.col("dx") + (F.lit(0.0) if zero else _vector(F.col("dt"), "x"))
    each = each.select(*KEY, "tap", (F.col("t") + F.col("dt")).alias("s_t"), py.alias("py"), px.alias("px"))
    if method == "nearest":
        at = each.select(*KEY, "tap", "s_t", fit(F.rint("py").cast("int"), "y").alias("s_y"), fit(F.rint("px").cast("int"), "x").alias("s_x"))
        return at.join(source, ["s_t", "s_y", "s_x"], "left").select(*KEY, "tap", F.col("s_v").alias("value"))
    fy, fx = F.floor("py"), F.floor("px")
    each = each.select(*KEY, "tap", "s_t", fy.alias("fy"), fx.alias("fx"), (F.col("py") - fy).alias("ay"), (F.col("px") - fx).alias("ax"))
    for axis in "yx":  # one after the other: an array of all pairs would hold each weight once for each of the other axis
        near = F.array(*(F.struct(fit((F.col(f"f{axis}") + i).cast("int"), axis).alias(f"s_{axis}"), w.alias(f"w{axis}")) for i, w in _weights(F.col(f"a{axis}"), method)))
        each = each.withColumn("c", F.explode(near)).select("*", "c.*").drop("c", f"f{axis}", f"a{axis}").where(f"w{axis} <> 0")
    met = each.withColumn("w", F.col("wy") * F.col("wx")).drop("wy", "wx").join(source, ["s_t", "s_y", "s_x"], "left")
    total = F.sum(F.col("w") * F.col("s_v"))
    whole = F.when(F.count(F.lit(1)) == F.count("s_v"), total / F.sum("w") if method == "lanczos" else total)
    return met.groupBy(*KEY, "tap").agg(whole.alias("value"))


def convolve(data: DataFrame, flow: DataFrame | None, offsets: Sequence[Offset], reduce: Column, method: str = "nearest", value: str = "v") -> DataFrame:
    """``t, y, x, value``: the taps of each pixel reduced by an aggregate over ``value`` (and ``tap``); NULL where
    the pixel itself is."""
    got = taps(data, flow, offsets, method, value).groupBy(*KEY).agg(reduce.alias("value"))
    return data.select(*KEY, F.col(value).alias("_own")).join(got, KEY).select(*KEY, F.when(F.col("_own").isNotNull(), F.col("value")).alias("value"))


def diff(data: DataFrame, flow: DataFrame, method: str = "linear", value: str = "v") -> DataFrame:
    """Lagrangian time difference: the mean of what there is of next - own and own - previous, 0 if neither is."""
    return tiles.moving(data, flow, tiles.diff, method, 0, value)


def filtered_tdiff(data: DataFrame, flow: DataFrame, method: str = "linear", value: str = "v") -> DataFrame:
    """Mean over the previous, own and next step along the flow."""
    return tiles.moving(data, flow, tiles.average, method, 0, value)


def time_steps(data: DataFrame, times: DataFrame | None = None) -> DataFrame:
    """``t, minutes``: centred time steps, one-sided at the ends. ``times``: ``t, seconds``; else a step is a minute."""
    steps = times if times is not None else data.select("t").distinct().withColumn("seconds", F.col("t") * 60.0)
    w = Window.orderBy("t")
    s, before, after = F.col("seconds"), F.lag("seconds").over(w), F.lead("seconds").over(w)
    d = F.when(before.isNull(), after - s).when(after.isNull(), s - before).otherwise((after - before) / 2)
    return steps.select("t", (d / 60).alias("minutes"))


def growth_rate(data: DataFrame, flow: DataFrame, method: str = "linear", times: DataFrame | None = None, value: str = "v") -> DataFrame:
    """Lagrangian difference per minute, then the mean over the cross of five pixels of the same step."""
    mean = tiles.moving(data, flow, tiles.growth, method, 1, value)
    return mean.join(F.broadcast(time_steps(data, times)), "t").select(*KEY, (F.col("value") / F.col("minutes")).alias("value"))


def sobel(data: DataFrame, flow: DataFrame, direction: str | None = None, method: str = "nearest", value: str = "v") -> DataFrame:
    """Magnitude of the 3-D Sobel gradient in the moving frame; ``uphill`` and ``downhill`` count only rises or
    falls from the centre (a missing tap counts as level there, and takes no part in the plain one)."""
    if direction not in (None, "uphill", "downhill"):
        raise ValueError("direction is None, uphill or downhill")
    return tiles.moving(data, flow, lambda tile: tiles.sobel(tile, direction), method, 1, value)


def argmin_tap(data: DataFrame, key: DataFrame, flow: DataFrame, offsets: Sequence[Offset], value: str = "v") -> DataFrame:
    """The value at the tap where ``key`` (its column ``v``) is least, the first tap on ties."""
    return tiles.moving(data, flow, lambda tile: tiles.lowest(tile, offsets)[1], "nearest", _reach(offsets), value, key=key)


def local_min(data: DataFrame, flow: DataFrame, offsets: Sequence[Offset], value: str = "v") -> DataFrame:
    """Whether a pixel is the least of its taps."""
    got = tiles.moving(data, flow, lambda tile: tiles.lowest(tile, offsets)[0] == tile.own, "nearest", _reach(offsets), value)
    return got.select(*KEY, (F.col("value") == 1).alias("value"))


def _reach(offsets: Sequence[Offset]) -> int:
    return max(abs(k) for o in offsets for k in o[1:])


def edge_field(data: DataFrame, flow: DataFrame, method: str = "linear", value: str = "v") -> DataFrame:
    """Uphill edges plus 1 where there are any, less the field; infinite where the field is missing."""
    s = sobel(data, flow, "uphill", method, value).withColumnRenamed("value", "s").join(data.select(*KEY, F.col(value).alias("v")), KEY)
    edge = F.when(F.col("s") > 0, F.col("s") + 1).otherwise(F.col("s")) - F.col("v")
    return s.select(*KEY, F.coalesce(edge, F.lit(float("inf"))).alias("value"))


def magnitude(flow: DataFrame, direction: str = "forward") -> DataFrame:
    if direction not in ("forward", "backward"):
        raise ValueError("direction is forward or backward")
    return flow.select(*KEY, F.hypot(*(("fx", "fy") if direction == "forward" else ("bx", "by"))).alias("value"))


def combine_flow(*flows: DataFrame) -> DataFrame:
    """Mean of several flows weighted by their magnitudes; NULL where all are still."""
    out = None
    for f in flows:
        out = f if out is None else out.unionByName(f)
    wf, wb = F.hypot("fx", "fy"), F.hypot("bx", "by")
    mean = lambda c, w: (F.sum(F.col(c) * w) / F.nullif(F.sum(w), F.lit(0.0))).alias(c)
    return out.groupBy(*KEY).agg(mean("fx", wf), mean("fy", wf), mean("bx", wb), mean("by", wb))


def parabolic(flow: DataFrame, at: float) -> DataFrame:
    """Displacement at a fractional time in [-1, 1] by the parabola through both vectors and 0."""
    f, b = 0.5 * at * (at + 1), 0.5 * at * (at - 1)
    return flow.select(*KEY, (f * F.col("fx") + b * F.col("bx")).alias("dx"), (f * F.col("fy") + b * F.col("by")).alias("dy"))


def smooth_flow(flow: DataFrame, method: str = "linear") -> DataFrame:
    """One pass of smoothing: each vector averaged with the reverse of the opposite one where it leads."""

    def side(own: str, dt: int, other: str) -> DataFrame:
        out = None
        for axis in "xy":
            reverse = taps(flow, flow, [(dt, 0, 0)], method, f"{other}{axis}").select(*KEY, F.col("value").alias("r"))
            one = flow.select(*KEY, F.col(f"{own}{axis}").alias("o")).join(reverse, KEY)
            one = one.select(*KEY, F.coalesce((F.col("o") - F.col("r")) / 2, F.col("o")).alias(f"{own}{axis}"))
            out = one if out is None else out.join(one, KEY)
        return out

    return side("f", 1, "b").join(side("b", -1, "f"), KEY)


class FlowFrame:
    """A flow field with the operators that move with it."""

    def __init__(self, df: DataFrame):
        missing = {*KEY, "fx", "fy", "bx", "by"} - set(df.columns)
        if missing:
            raise ValueError(f"a flow has columns t, y, x, fx, fy, bx, by; missing: {sorted(missing)}")
        self.df = df

    @property
    def flow(self) -> DataFrame:
        return self.df

    def __getitem__(self, condition: Column | str) -> FlowFrame:
        return FlowFrame(self.df.where(condition))

    def convolve(self, data: DataFrame, offsets: Sequence[Offset] | None = None, reduce: Column | None = None, method: str = "linear", value: str = "v") -> DataFrame:
        offsets = full(1) if offsets is None else offsets
        return taps(data, self.df, offsets, method, value) if reduce is None else convolve(data, self.df, offsets, reduce, method, value)

    def diff(self, data: DataFrame, method: str = "linear", value: str = "v") -> DataFrame:
        return diff(data, self.df, method, value)

    def sobel(self, data: DataFrame, direction: str | None = None, method: str = "linear", value: str = "v") -> DataFrame:
        return sobel(data, self.df, direction, method, value)

    def watershed(self, field: DataFrame, markers: DataFrame, allowed: DataFrame | None = None, chunk: int | None = None) -> DataFrame:
        from driftframe.operators import flooding

        return flooding.watershed(self.df, field, markers, allowed, chunk)

    def label(self, mask: DataFrame, overlap: float = 0.0, absolute_overlap: int = 1, shrink: float = 0.0, undirected: bool = False) -> DataFrame:
        from driftframe.operators import tracking

        return tracking.flow_label(self.df, mask, overlap, absolute_overlap, shrink, undirected=undirected)

    def link_overlap(self, steps: DataFrame, overlap: float = 0.0, absolute_overlap: int = 1, undirected: bool = False) -> DataFrame:
        from driftframe.operators import tracking

        return tracking.link_overlap(self.df, steps, overlap, absolute_overlap, undirected)
