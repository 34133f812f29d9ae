"""Validation of objects against point events: distances in space and time, detection and false-alarm rates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftframe.operators import kernels
from driftframe.operators.frames import distance, nearest
from driftframe.operators.stencil import KEY
from driftframe.sources.store import stored

#: Pixels of a row whose steps make up one task of ``ellipse_distance``.
COLUMNS = 8


def cylinder_distance(markers: DataFrame, time_margin: int = 3, ids: bool = False) -> DataFrame:
    """``v``: distance of each pixel to the nearest marker (``label`` not 0) of its step or of ``time_margin`` steps on
    either side; NULL where none is. With ``ids`` also ``nearest``, its label, of the earliest step on ties."""
    w = Window.partitionBy("y", "x").orderBy("t").rangeBetween(-time_margin, time_margin)
    if not ids:
        return distance(markers.select(*KEY, (F.col("label") != 0).alias("m"))).withColumn("v", F.min("v").over(w))
    best = F.min(F.when(F.col("v").isNotNull(), F.struct("v", "t", "near"))).over(w)
    return nearest(markers).withColumn("_b", best).select(*KEY, F.col("_b.v").alias("v"), F.col("_b.near").alias("nearest"))


def ellipse_distance(markers: DataFrame, time_margin: float, margin: float) -> DataFrame:
    """``v, nearest``: distance of each pixel to the nearest marker of any step, a step counting as ``margin /
    time_margin`` pixels, and its label, of the earliest step on ties; NULL where the cube has none. The distances within
    steps are carried over time by ``kernels.carried``, ``COLUMNS`` pixels of a row at a time."""
    step = margin / time_margin

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["x", "t"], kind="stable")
        mine = part["own"].to_numpy(dtype=bool)
        own = part["v"].to_numpy(dtype=float, na_value=np.nan)
        # squares of distances between pixels are whole numbers
        v, at = kernels.carried(part["x"].to_numpy(), part["t"].to_numpy(), np.rint(own * own), step)
        ok = at >= 0
        near = part["near"].to_numpy(dtype=float, na_value=0)[at].astype(np.int64)
        out = pd.DataFrame({c: part[c].to_numpy() for c in KEY})
        return out.assign(v=pd.Series(np.where(ok, v, 0.0)).astype(object).where(ok, None), nearest=pd.Series(near).astype(object).where(ok, None))[mine]

    b = markers.agg(*(f(c).alias(f"{c}{k}") for c in "yx" for k, f in ((0, F.min), (1, F.max)))).first()
    # a step may lack pixels whose nearest marker it has
    box = None if b["y0"] is None else tuple(int(b[c]) for c in ("y0", "y1", "x0", "x1"))
    return nearest(markers, box or (0, 0, 0, 0)).groupBy("y", F.floor(F.col("x") / COLUMNS)).applyInPandas(run, "t int, y int, x int, v double, nearest long")


def edge_filter(grid: DataFrame, margin: int, time_margin: int, missing: Column | None = None, times: DataFrame | None = None, longest_gap: float = 900.0) -> DataFrame:
    """``inside``: farther than the margins from the sides of the domain and its ends in time; ``missing`` marks pixels
    without observations, whose surroundings within the same margins are not inside either. With ``times`` (``t,
    seconds``), neither are steps within ``time_margin`` of a gap of over ``longest_gap`` seconds."""
    b = grid.agg(*(f(c).alias(f"{c}{k}") for c in KEY for k, f in ((0, F.min), (1, F.max))))
    c = F.col
    inside = lambda n, m: (c(n) >= c(f"{n}0") + m) & (c(n) <= c(f"{n}1") - m)
    out = grid.join(F.broadcast(b)).withColumn("inside", inside("y", margin) & inside("x", margin) & inside("t", time_margin))
    if times is not None:
        w = Window.orderBy("t")  # one row for each step
        gaps = times.select("t", (F.lead("seconds").over(w) - c("seconds") > longest_gap).alias("gap")).where("gap")
        lost = gaps.select(F.explode(F.sequence(c("t") - time_margin + 1, c("t") + time_margin + 1)).alias("t")).distinct().withColumn("_lost", F.lit(True))
        out = out.join(lost, "t", "left").withColumn("inside", c("inside") & c("_lost").isNull())
    if missing is not None:
        holes = cylinder_distance(grid.select(*KEY, F.coalesce(missing, F.lit(False)).cast("int").alias("label")), time_margin).withColumnRenamed("v", "_far")
        out = out.join(holes, KEY).withColumn("inside", c("inside") & F.coalesce(c("_far") >= margin, F.lit(True)))
    return out.select(*KEY, "inside")


def only(pixels: DataFrame, kept: DataFrame) -> DataFrame:
    """Pixels whose label is not in ``kept`` (``label``) are background."""
    known = kept.select("label").distinct().withColumn("_k", F.lit(True))
    return pixels.join(known, "label", "left").select(*KEY, F.when(F.col("_k"), F.col("label")).otherwise(0).alias("label"))


def with_partners(cores: DataFrame, anvils: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The cores that have an anvil and the anvils that have a core. ``index``: ``core, anvil``, 0 for none."""
    linked = index.where("core <> 0 and anvil <> 0")
    return only(cores, linked.select(F.col("core").alias("label"))), only(anvils, linked.select(F.col("anvil").alias("label")))


def validate(markers: DataFrame, events: DataFrame, marker_distance: DataFrame, event_distance: DataFrame, inside: DataFrame, margin: float = 10.0) -> tuple[DataFrame, DataFrame]:
    """Objects (``label, distance, in_margin``) and one row of ``pod, far, f1, n_events, n_objects``.

    ``events``: ``n`` at ``t, y, x``. Detection: the share of events inside the filter within ``margin`` of a marker.
    False alarms: the share of objects wholly inside the filter with no event within ``margin``.
    """
    e = events.join(inside, KEY).where("inside and n > 0").join(marker_distance.withColumnRenamed("v", "d"), KEY)
    pod = e.agg((F.sum(F.when(F.col("d") <= margin, F.col("n")).otherwise(0)) / F.sum("n")).alias("pod"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_events"))
    m = markers.where(F.col("label") != 0).join(inside, KEY).join(event_distance.withColumnRenamed("v", "d"), KEY)
    objects = m.groupBy("label").agg(F.min("d").alias("distance"), F.bool_and("inside").alias("in_margin"))
    wrong = (F.coalesce(F.col("distance") > margin, F.lit(True))).cast("int")
    far = objects.agg(F.avg(F.when(F.col("in_margin"), wrong)).alias("far"), F.count(F.when(F.col("in_margin"), 1)).alias("n_objects"))
    f1 = 2 * F.col("pod") * (1 - F.col("far")) / F.nullif(F.col("pod") + 1 - F.col("far"), F.lit(0.0))
    return objects, pod.join(far).withColumn("f1", f1)


def validate_all(kinds: dict[str, DataFrame], events: DataFrame, grid: DataFrame, inside: DataFrame, margin: float = 10.0, time_margin: int = 3) -> tuple[DataFrame, DataFrame]:
    """``validate`` for each kind of object (cores, anvils, markers, those with partners): its results with ``kind``."""
    on_grid = grid.select(*KEY).join(events, KEY, "left").select(*KEY, F.coalesce("n", F.lit(0)).alias("label"))
    event_distance, out = stored(cylinder_distance(on_grid, time_margin)), None
    for kind, pixels in kinds.items():
        both = [df.withColumn("kind", F.lit(kind)) for df in validate(pixels, events, cylinder_distance(pixels, time_margin), event_distance, inside, margin)]
        out = both if out is None else [a.unionByName(b) for a, b in zip(out, both, strict=True)]
    return tuple(out)


def distance_histogram(distances: DataFrame, column: str = "d", bins: int = 40) -> DataFrame:
    """Share of the distances in unit bins up to ``bins``, the last right end included."""
    total = distances.where(F.col(column).isNotNull()).agg(F.count(F.lit(1)).alias("_n"))
    inside = distances.where(F.col(column).between(0, bins)).groupBy(F.least(F.floor(column), F.lit(bins - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return inside.join(F.broadcast(total)).select("bin", (F.col("n") / F.col("_n")).alias("share"))
