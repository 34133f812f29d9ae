"""Objects from their steps: roll-ups, filters with cascades, edge and gap flags, validity.

Tables: ``core`` and ``anvil`` (one row for each object), ``core_step``, ``thick_anvil_step``, ``thin_anvil_step`` (one
row for each object and step). A roll-up is one aggregation by object; what needs the order of steps is one
window before it on the same key, so both share a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftframe.functions.stats import arg_extreme, gradient, wmean
from driftframe.operators import labels, linking
from driftframe.sources.store import stored

#: Step fields whose extremes are reported: name, whether the largest is of interest, whether a rate of change is.
EXTREMES = (("bt", False, True), ("ctt", False, True), ("ctt_corrected", False, True), ("cth", True, True), ("cth_corrected", True, True))


def roll_up(steps: DataFrame, key: str, prefix: str, rates: bool = True, propagation: bool = True) -> DataFrame:
    """One row for each object from its steps.

    ``steps`` has ``key``, ``step``, ``t`` (seconds), ``area`` and any of ``x, y, lat, lon``, of the fields in
    ``EXTREMES`` and of columns that end in ``_mean, _std, _min, _max, _mean_uncertainty, _mean_combined_error``;
    what is there decides what comes out: positions at start and end, lifetime, area-weighted means, total and
    largest area, extremes of fields with their time and step, rates of change, propagation, and the roll-up of
    each suffixed column over steps.
    """
    cols = set(steps.columns)
    w = Window.partitionBy(key).orderBy("t", "step")
    area = F.col("area")
    rows, out = steps, []
    first = lambda c: F.min_by(c, F.struct("t", "step"))
    last = lambda c: F.max_by(c, F.struct(F.col("t"), -F.col("step")))
    out += [F.min("t").alias(f"{prefix}_start_t"), F.max("t").alias(f"{prefix}_end_t"), (F.max("t") - F.min("t")).alias(f"{prefix}_lifetime"), first("step").alias(f"{prefix}_initial_step_index")]
    for c in ("x", "y", "lat", "lon"):
        if c in cols:
            out += [first(c).alias(f"{prefix}_start_{c}"), last(c).alias(f"{prefix}_end_{c}"), wmean(F.col(c), area).alias(f"{prefix}_average_{c}")]
    out += [F.avg("area").alias(f"{prefix}_average_area"), F.sum("area").alias(f"{prefix}_total_area"), F.max("area").alias(f"{prefix}_max_area"), arg_extreme("t", "area", "step", True).alias(f"{prefix}_max_area_t"), arg_extreme("step", "area", "step", True).alias(f"{prefix}_max_area_step_index")]
    for name, largest, rate in EXTREMES:
        if name not in cols:
            continue
        word = "max" if largest else "min"
        out += [(F.max(name) if largest else F.min(name)).alias(f"{prefix}_{word}_{name}"), arg_extreme("t", name, "step", largest).alias(f"{prefix}_{word}_{name}_t"), arg_extreme("step", name, "step", largest).alias(f"{prefix}_{word}_{name}_step_index")]
        if rate and rates:
            rows = rows.withColumn(f"_d_{name}", gradient(name, "t", w) * 60)
            d = F.col(f"_d_{name}")
            label = f"{prefix}_{name}_growth_rate" if largest else f"{prefix}_{name}_cooling_rate"
            out += [(F.max(d) if largest else -F.min(d)).alias(label), F.min_by("step", F.when(d.isNotNull(), F.struct(-d if largest else d, F.col("t")))).alias(f"{label}_step_index")]
    if propagation and {"lat", "lon"} <= cols:
        from driftframe.functions.geo import azimuth, great_circle

        rows = rows.withColumns({"_lat": F.lead("lat").over(w), "_lon": F.lead("lon").over(w), "_t": F.lead("t").over(w)})
        here, there = (F.col("lat"), F.col("lon")), (F.col("_lat"), F.col("_lon"))
        rows = rows.withColumns({"_az": F.radians(azimuth(*here, *there)), "_speed": great_circle(*here, *there) * 1000 / F.nullif(F.col("_t") - F.col("t"), F.lit(0.0))})
        out += [F.degrees(F.atan2(F.avg(F.sin("_az")), F.avg(F.cos("_az")))).alias(f"{prefix}_propagation_direction"), F.avg("_speed").alias(f"{prefix}_propagation_speed")]
    for c in sorted(cols):
        v = F.col(c)
        if c.endswith("_mean_uncertainty"):
            out.append((F.sqrt(F.sum(area * area * v * v)) / F.nullif(F.sum(area), F.lit(0.0))).alias(f"{prefix}_{c}"))
        elif c.endswith("_mean"):
            out.append(wmean(v, area).alias(f"{prefix}_{c}"))
        elif c.endswith("_min"):
            out.append(F.min(v).alias(f"{prefix}_{c}"))
        elif c.endswith("_max"):
            out.append(F.max(v).alias(f"{prefix}_{c}"))
        elif c.endswith("_std") and c[: -len("_std")] + "_mean" in cols:
            mean = c[: -len("_std")] + "_mean"
            over = Window.partitionBy(key)
            rows = rows.withColumn(f"_c_{mean}", F.sum(F.col(mean) * area).over(over) / F.nullif(F.sum(F.when(F.col(mean).isNotNull(), area)).over(over), F.lit(0.0)))
            d = F.col(mean) - F.col(f"_c_{mean}")
            out.append(F.sqrt(F.sum(area * (v + d * d)) / F.nullif(F.sum(F.when(v.isNotNull(), area)), F.lit(0.0))).alias(f"{prefix}_{c}"))
    return rows.groupBy(key).agg(*out)


def core_properties(steps: DataFrame) -> DataFrame:
    return roll_up(steps, "core", "core")


def thick_anvil_properties(steps: DataFrame) -> DataFrame:
    return roll_up(steps, "anvil", "thick_anvil", rates=False)


def thin_anvil_properties(steps: DataFrame) -> DataFrame:
    return roll_up(steps, "anvil", "thin_anvil", rates=False, propagation=False)


def label_properties(pixels: DataFrame, step: str, entity: str) -> tuple[DataFrame, DataFrame]:
    """Per step and per object: pixels, area, time, area-weighted position; start, end, lifetime, largest step.

    ``pixels``: ``t, area``, the step and object labels and any of ``x, y, lat, lon``. Pixels are read once; objects
    are rolled up from the steps.
    """
    area = F.col("area")
    where = [c for c in ("x", "y", "lat", "lon") if c in pixels.columns]
    s = pixels.where((F.col(step) != 0) & (F.col(entity) != 0)).groupBy(entity, step).agg(
        F.count(F.lit(1)).alias("pixel_count"), F.sum("area").alias("area"), F.min("t").alias("t"), *(wmean(F.col(c), area).alias(c) for c in where),
    )
    e = s.groupBy(entity).agg(
        F.sum("pixel_count").alias("pixel_count"), F.sum("area").alias("total_area"), F.max("area").alias("max_area"), F.min("t").alias("start_t"), F.max("t").alias("end_t"),
        (F.max("t") - F.min("t")).alias("lifetime"), arg_extreme("t", "area", step, True).alias("max_area_t"), *(F.min_by(c, step).alias(f"start_{c}") for c in where),
    )
    return s, e


def gaps(steps: DataFrame, key: str) -> DataFrame:
    """``max_gap``: the longest time between consecutive steps of an object, 0 for a single one."""
    w = Window.partitionBy(key).orderBy("t")
    return steps.withColumn("_g", F.lead("t").over(w) - F.col("t")).groupBy(key).agg(F.coalesce(F.max("_g"), F.lit(0.0)).alias("max_gap"))


#: Ids up to which they are sent whole to all executors.
MOST_IDS = 1 << 20


def _ids(df: DataFrame, key: str) -> DataFrame:
    """The ids of a table, once each, kept. Steps are filtered by few ids where they are: dealt out by them, a few objects with
    many steps would be a task each."""
    ids = stored(df.select(key).distinct())
    return F.broadcast(ids) if ids.count() <= MOST_IDS else ids


@dataclass
class Objects:
    """The tables of a set of tracked objects."""

    core: DataFrame
    anvil: DataFrame
    core_step: DataFrame
    thick_anvil_step: DataFrame
    thin_anvil_step: DataFrame

    def only(self, core: DataFrame | None = None, anvil: DataFrame | None = None) -> Objects:
        """Objects whose ids are in the given tables, and their steps."""
        c = self.core if core is None else self.core.join(_ids(core, "core"), "core", "left_semi")
        a = self.anvil if anvil is None else self.anvil.join(_ids(anvil, "anvil"), "anvil", "left_semi")
        cores, anvils = _ids(c, "core"), _ids(a, "anvil")
        semi = lambda df, ids, k: df.join(ids, k, "left_semi")
        return Objects(c, a, semi(self.core_step, cores, "core"), semi(self.thick_anvil_step, anvils, "anvil"), semi(self.thin_anvil_step, anvils, "anvil"))

    def at(self, kind: str, positions: Sequence[int]) -> Objects:
        """Objects by their places, from 0, in the order of their ids."""
        own = getattr(self, kind)
        picked = own.join(labels.numbered(own, [kind], "_i"), kind).where((F.col("_i") - 1).isin(*positions)).drop("_i")
        return self.only(**{kind: picked})

    def without_orphans(self) -> Objects:
        """Cores with steps, anvils with thick and thin steps, and the steps of those."""
        held = lambda df, steps, k: df.join(_ids(steps, k), k, "left_semi")
        anvils = held(held(self.anvil, self.thick_anvil_step, "anvil"), self.thin_anvil_step, "anvil")
        return self.only(held(self.core, self.core_step, "core"), anvils)


def valid_cores(steps: DataFrame, min_lifetime: float = 14 * 60, max_gap: float = 16 * 60, min_cooling: float = 8.0, max_area: float = 1e4) -> DataFrame:
    """``core`` and what it is judged by, for cores that cool enough from first to last step, live long enough,
    have no long gap, are not too large, and have no step with missing values while flagged (``nan_flag``)."""
    w = Window.partitionBy("core").orderBy("t")
    rows = steps.withColumn("_g", F.lead("t").over(w) - F.col("t"))
    bad = F.bool_or(F.col("bt").isNull()) & F.bool_or(F.coalesce("nan_flag", F.lit(False))) if "nan_flag" in steps.columns else F.lit(False)
    cooling = F.min_by("bt", "step") - F.max_by("bt", "step")
    agg = rows.groupBy("core").agg(
        cooling.alias("cooling"), F.coalesce(F.max("_g"), F.lit(0.0)).alias("max_gap"), (F.max("t") - F.min("t")).alias("lifetime"), F.max("area").alias("max_area"), bad.alias("bad"),
    )
    return agg.where((F.col("cooling") >= min_cooling) & (F.col("max_gap") <= max_gap) & (F.col("lifetime") >= min_lifetime) & (F.col("max_area") <= max_area) & ~F.col("bad")).drop("bad")


def valid_anvils(anvil: DataFrame, thick: DataFrame, thin: DataFrame, core: DataFrame, core_step: DataFrame, min_lifetime: float = 14 * 60, max_gap: float = 16 * 60) -> DataFrame:
    """``anvil`` of anvils with a core that live long enough without a long gap, grow larger than any of their cores
    and outlast the last of them."""
    cores = core_step.join(core.select("core", "anvil"), "core").groupBy("anvil").agg(F.max("area").alias("core_area"), F.max("t").alias("core_end"))
    w = Window.partitionBy("anvil").orderBy("t")
    t = thick.withColumn("_g", F.lead("t").over(w) - F.col("t")).groupBy("anvil").agg(
        F.max("area").alias("area"), F.max("t").alias("end"), (F.max("t") - F.min("t")).alias("lifetime"), F.coalesce(F.max("_g"), F.lit(0.0)).alias("gap")
    )
    both = anvil.select("anvil").join(cores, "anvil").join(t, "anvil").join(thin.select("anvil").distinct(), "anvil", "left_semi")
    return both.where((F.col("lifetime") >= min_lifetime) & (F.col("gap") <= max_gap) & (F.col("area") > F.col("core_area")) & (F.col("end") > F.col("core_end"))).select("anvil")


def validity_flags(core: DataFrame, anvil: DataFrame) -> DataFrame:
    """Anvils with ``core_count, initial_core, no_growth, no_initial_core, invalid_core, is_valid``.

    ``core``: ``core, anvil, start_t, end_t, is_good``; ``anvil``: ``anvil, start_t, max_area_t``. The initial core is
    the earliest; an anvil grows if it is largest after that core has ended.
    """
    c = core.where(F.coalesce("anvil", F.lit(0)) != 0).groupBy("anvil").agg(
        F.count(F.lit(1)).alias("core_count"), F.min_by("core", F.struct("start_t", "core")).alias("initial_core"), F.min_by("end_t", F.struct("start_t", "core")).alias("_end"),
        F.min("start_t").alias("_start"), F.bool_and("is_good").alias("_good"),
    )
    j = anvil.join(c, "anvil", "left")
    no_growth = F.coalesce(F.col("max_area_t") <= F.col("_end"), F.lit(False))
    no_initial = F.coalesce(F.col("start_t") < F.col("_start"), F.lit(False))
    invalid = ~F.coalesce("_good", F.lit(False))
    out = j.select("anvil", F.coalesce("core_count", F.lit(0)).alias("core_count"), F.coalesce("initial_core", F.lit(0)).alias("initial_core"), no_growth.alias("no_growth"), no_initial.alias("no_initial_core"), invalid.alias("invalid_core"))
    return out.withColumn("is_valid", (F.col("core_count") > 0) & ~F.col("no_growth") & ~F.col("no_initial_core") & ~F.col("invalid_core"))


def edge_flags(pixels: DataFrame, max_gap: float = 900.0, start: float | None = None, end: float | None = None, gap_fix: bool = False) -> DataFrame:
    """``label, edge, start, end``: labels at the sides of the domain, at or before its start, at or after its end, or
    next to a gap in time. The step before a gap flags starts and the step after it ends, unless ``gap_fix``."""
    b = pixels.agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("t").alias("t0"), F.max("t").alias("t1"))
    w = Window.orderBy("t")
    times = pixels.select("t").distinct().withColumns({"_before": F.col("t") - F.lag("t").over(w), "_after": F.lead("t").over(w) - F.col("t")})
    ends, begins = F.coalesce(F.col("_after") > max_gap, F.lit(False)), F.coalesce(F.col("_before") > max_gap, F.lit(False))
    times = times.select("t", (begins if gap_fix else ends).alias("_s"), (ends if gap_fix else begins).alias("_e"))
    p = pixels.where(F.col("label") != 0).join(F.broadcast(times), "t").join(F.broadcast(b))
    first = F.col("t") <= (F.col("t0") if start is None else F.greatest(F.col("t0"), F.lit(start)))
    last = F.col("t") >= (F.col("t1") if end is None else F.least(F.col("t1"), F.lit(end)))
    side = (F.col("y") == F.col("y0")) | (F.col("y") == F.col("y1")) | (F.col("x") == F.col("x0")) | (F.col("x") == F.col("x1"))
    return p.groupBy("label").agg(F.bool_or(side).alias("edge"), F.bool_or(first | F.col("_s")).alias("start"), F.bool_or(last | F.col("_e")).alias("end"))


def nan_adjacent(pixels: DataFrame, value: str = "v") -> DataFrame:
    """``label, nan_flag``: whether a label touches the 3 x 3 x 3 surroundings of a missing value."""
    shift = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("dt", "dy", "dx"), (t, y, x), strict=True))) for t in (-1, 0, 1) for y in (-1, 0, 1) for x in (-1, 0, 1)))
    holes = pixels.where(F.col(value).isNull()).select("t", "y", "x", F.explode(shift).alias("o"))
    near = holes.select((F.col("t") + F.col("o.dt")).alias("t"), (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x")).distinct().withColumn("_n", F.lit(True))
    own = pixels.where(F.col("label") != 0).join(near, ["t", "y", "x"], "left")
    return own.groupBy("label").agg(F.bool_or(F.coalesce("_n", F.lit(False))).alias("nan_flag"))


def upsert_flags(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each object from several files: edge and nan flags if any, the oldest start and newest end flag,
    the first parent that is not 0."""
    linked = F.when(F.coalesce("parent", F.lit(0)) != 0, F.col(order))
    return rows.groupBy(key).agg(
        F.bool_or("edge").alias("edge"), F.bool_or("nan").alias("nan"), F.min_by("start", order).alias("start"), F.max_by("end", order).alias("end"),
        F.coalesce(F.min_by("parent", linked), F.lit(0)).alias("parent"),
    )


def monthly(objects: DataFrame, key: str, month: Column) -> DataFrame:
    """Each object in the month of its first step only: objects of an earlier month are not counted again."""
    return objects.withColumn("_m", month).withColumn("month", F.min("_m").over(Window.partitionBy(key))).drop("_m")


def combined_files(objects: DataFrame, steps: DataFrame, key: str, time: str = "t") -> tuple[DataFrame, DataFrame]:
    """Objects and steps of many linked files as one table each, with ``month`` of the object's first step.

    ``objects``: ``file``, ``key`` (the same in all files) and ``edge, nan, start, end, parent``; flags of an object that
    several files have are merged. ``steps``: ``file, step``, ``key`` and the timestamp ``time``; steps are numbered on
    from file to file. An object belongs to the month in which it begins, whatever file its steps are in.
    """
    files = linking.offsets(steps.groupBy("file").agg(F.max("step").alias("max_label"))).select("file", "start")
    numbered = steps.join(files, "file").withColumn("step", F.col("start") + F.col("step")).drop("start", "file")
    numbered = monthly(numbered, key, F.trunc(time, "month"))
    months = numbered.groupBy(key).agg(F.first("month").alias("month"))
    return upsert_flags(objects, key, "file").join(months, key), numbered
