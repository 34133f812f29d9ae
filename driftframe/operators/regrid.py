"""Point observations onto grids and time steps: bins, interval and nearest joins, layered means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def edges(coords: DataFrame, name: str = "c") -> DataFrame:
    """``i, lo, hi`` for sorted coordinates: midpoints inside, the outer coordinates themselves at the ends."""
    w = Window.orderBy(name)
    before, after = F.lag(name).over(w), F.lead(name).over(w)
    c = F.col(name)
    return coords.select(name).distinct().select((F.row_number().over(w) - 1).alias("i"), name, F.coalesce((before + c) / 2, c).alias("lo"), F.coalesce((c + after) / 2, c).alias("hi"))


def binned(points: DataFrame, grid: DataFrame, value: str, name: str) -> DataFrame:
    """Points with the number of their bin; the last bin holds its right end, points outside all go.

    ``grid`` is ``edges`` of one axis, regular or not. The axis is cut into as many slots as it has cells; a cell lies
    in the slots that it touches, about two for each cell in all, and points meet cells in equal slots.
    """
    axis = grid.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("i").alias("n")).first()
    if axis["n"] is None:
        return points.limit(0).withColumn(name, F.lit(None).cast("int"))
    width = (axis["hi"] - axis["lo"]) / (axis["n"] + 1) or 1.0
    slot = lambda c: F.floor((c - axis["lo"]) / width)
    cells = grid.select(F.col("i").alias(name), "lo", "hi", F.explode(F.sequence(slot(F.col("lo")), slot(F.col("hi")))).alias("_slot"))
    own, v = points.withColumn("_slot", slot(F.col(value))), F.col(value)
    inside = (v >= F.col("lo")) & ((v < F.col("hi")) | ((F.col(name) == axis["n"]) & (v == F.col("hi"))))
    return own.join(cells, "_slot").where(inside).drop("_slot", "lo", "hi")


def windows(times: DataFrame, cap: float = 900.0, time: str = "s") -> DataFrame:
    """``t, s, lo, hi``: half the gap to the neighbours, gaps capped; the end gaps serve on both sides."""
    w = Window.orderBy(time)
    gap = lambda c: F.least(c, F.lit(cap)) / 2
    before, after = F.col(time) - F.lag(time).over(w), F.lead(time).over(w) - F.col(time)
    low, high = F.coalesce(before, after, F.lit(cap)), F.coalesce(after, before, F.lit(cap))
    return times.withColumns({"lo": F.col(time) - gap(low), "hi": F.col(time) + gap(high)})


def interval_join(points: DataFrame, spans: DataFrame, time: str = "s", slot: float = 900.0, closed_left: bool = False) -> DataFrame:
    """Points inside each span (ends excluded; the left one included if ``closed_left``). Both sides are cut into
    slots of ``slot`` seconds, a span into all it touches, so the join is on equal slots rather than all pairs."""
    p = points.withColumn("_slot", F.floor(F.col(time) / slot))
    s = spans.withColumn("_slot", F.explode(F.sequence(F.floor(F.col("lo") / slot), F.floor(F.col("hi") / slot))))
    drop = [time] if time in spans.columns else []
    left = p[time] >= s["lo"] if closed_left else p[time] > s["lo"]
    return p.join(s.drop(*drop), (p["_slot"] == s["_slot"]) & left & (p[time] < s["hi"])).drop("_slot", "lo", "hi")


def asof_nearest(left: DataFrame, right: DataFrame, tolerance: float, time: str = "s", by: Sequence[str] = ()) -> DataFrame:
    """Each row of ``left`` with the row of ``right`` nearest in time within ``tolerance``, the earlier on ties; NULL
    without any. Rows meet in slots of the tolerance's length."""
    names = [c for c in right.columns if c not in by]
    r = right.select(*by, F.col(time).alias("_r"), F.struct(*(F.col(c) for c in names)).alias("_row"))
    r = r.withColumn("_slot", F.explode(F.array(*(F.floor(F.col("_r") / tolerance) + k for k in (-1, 0, 1)))))
    own = left.withColumn("_id", F.monotonically_increasing_id()).withColumn("_slot", F.floor(F.col(time) / tolerance))
    met = own.join(r, [*by, "_slot"], "left").withColumn("_d", F.abs(F.col("_r") - F.col(time)))
    best = met.groupBy("_id", *left.columns).agg(F.min_by("_row", F.when(F.col("_d") <= tolerance, F.struct("_d", "_r"))).alias("_row"))
    return best.select(*left.columns, *(F.col(f"_row.{c}").alias(c if c not in left.columns else f"{c}_right") for c in names))


def counted(points: DataFrame, grid: DataFrame, covered: DataFrame | None = None) -> DataFrame:
    """``n`` on each cell ``t, y, x`` of the grid: the number of points, 0 without any, -1 at steps not ``covered``."""
    n = points.groupBy("t", "y", "x").agg(F.count(F.lit(1)).alias("n"))
    out = grid.select("t", "y", "x").join(n, ["t", "y", "x"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    if covered is None:
        return out
    return out.join(F.broadcast(covered.select("t").distinct().withColumn("_c", F.lit(True))), "t", "left").withColumn("n", F.when(F.col("_c"), F.col("n")).otherwise(-1)).drop("_c")


def layered(gates: DataFrame, low: float = 2500.0, high: float = 10000.0, step: float = 500.0) -> DataFrame:
    """Cells ``t, y, x`` from gates with ``alt`` and ``ref`` (NULL: no echo): ``raw`` and ``valid`` counts, the mean, and
    the largest mean of a layer."""
    inside = gates.where((F.col("alt") > low) & (F.col("alt") < high)).withColumn("layer", F.floor((F.col("alt") - low) / step))
    layers = inside.groupBy("t", "y", "x", "layer").agg(F.count(F.lit(1)).alias("raw"), F.count("ref").alias("valid"), F.sum("ref").alias("sum"))
    mean = F.sum("sum") / F.nullif(F.sum("valid"), F.lit(0))
    return layers.groupBy("t", "y", "x").agg(F.sum("raw").alias("raw"), F.sum("valid").alias("valid"), mean.alias("mean"), F.max(F.col("sum") / F.nullif("valid", F.lit(0))).alias("max"))


def combined_sites(cells: DataFrame, floor: float = -33.0) -> DataFrame:
    """Cells of several sites: means weighted by counts; NULL where none has scanned, ``floor`` where no echo is."""
    total = F.sum(F.col("mean") * F.col("valid")) / F.nullif(F.sum("valid"), F.lit(0))
    return cells.groupBy("t", "y", "x").agg(F.when(F.sum("raw") > 0, F.coalesce(total, F.lit(floor))).alias("ref"))


def degree_bins(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Whole-degree cells; the north and east ends belong to the last ones."""
    return F.least(F.floor(lat), F.lit(89)), F.least(F.floor(lon), F.lit(179))


def sites_inside(sites: DataFrame, bounds: DataFrame, extend: float = 0.005) -> DataFrame:
    """Sites strictly inside a box ``lat0, lat1, lon0, lon1`` of one row, widened by ``extend``."""
    b = F.broadcast(bounds.limit(1))
    return sites.join(b, (F.col("lat") > F.col("lat0") - extend) & (F.col("lat") < F.col("lat1") + extend) & (F.col("lon") > F.col("lon0") - extend) & (F.col("lon") < F.col("lon1") + extend)).select(*sites.columns)
