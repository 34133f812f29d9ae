"""Detection of growing cores and of the anvils around them: compositions of stencils, morphology and labels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftframe.functions.normalise import linearise
from driftframe.operators import flooding, frames, labels, morphology, stencil, tiles, tracking
from driftframe.operators.linking import stored
from driftframe.operators.stencil import KEY


def combined_filter(flow: DataFrame, bt: DataFrame, wvd: DataFrame | None = None, swd: DataFrame | None = None) -> DataFrame:
    """``f``: 1 where the field bends or peaks (either channel), dilated over the previous and next step along the flow,
    filled and opened; less where ``swd`` shows cirrus."""
    m = None
    for field, direction in ((bt, "positive"), (wvd, "negative")):
        if field is None:
            continue
        for one in (frames.curvature_filter(field, direction=direction), frames.peak_filter(field, 0.5, direction=direction)):
            m = one if m is None else m.join(one.withColumnRenamed("m", "o"), KEY).select(*KEY, (F.col("m") | F.col("o")).alias("m"))
    around = lambda tile: np.maximum.reduce([np.nan_to_num(tile.tap(dt)) for dt in (-1, 0, 1)])
    m = tiles.moving(m, flow, around, "nearest", 0, "m").select(*KEY, (F.col("value") > 0).alias("m"))
    m = morphology.opening(frames.fill_holes(m)).withColumn("f", F.col("m").cast("double")).drop("m")
    if swd is None:
        return m
    clear = swd.select(*KEY, F.coalesce(1 - linearise(F.col("v"), 2.5, 7.5), F.lit(1.0)).alias("_c"))
    return m.join(clear, KEY).select(*KEY, (F.col("f") * F.col("_c")).alias("f"))


def growth_mask(flow: DataFrame, field: DataFrame, threshold: float, filters: DataFrame | None = None, method: str = "cubic", sign: float = 1.0, times: DataFrame | None = None) -> DataFrame:
    """``m``: where the (signed) field, times ``f`` of the filters, grows faster than ``threshold`` per minute."""
    g = stencil.growth_rate(field.withColumn("v", F.col("v") * sign), flow, method, times)
    if filters is not None:
        g = g.join(filters, KEY).withColumn("value", F.col("value") * F.col("f"))
    return g.select(*KEY, F.coalesce(F.col("value") > threshold, F.lit(False)).alias("m"))


def smoothed_growth(flow: DataFrame, field: DataFrame, times: DataFrame | None = None) -> DataFrame:
    """``value``: the Lagrangian difference per minute, averaged over the steps before and after along the flow."""
    rate = stencil.diff(field, flow).join(F.broadcast(stencil.time_steps(field, times)), "t").select(*KEY, (F.col("value") / F.col("minutes")).alias("v"))
    return stencil.filtered_tdiff(stored(rate), flow)


def growth_markers(flow: DataFrame, wvd: DataFrame, lower: float = 0.25, upper: float = 0.5, driest: float = -5.0, min_length: int = 3, overlap: float = 0.0, absolute: int = 1, times: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The smoothed growth of a field, and ``label``: regions that bend down and grow by ``lower`` per minute, linked
    along the flow, that last ``min_length`` steps, somewhere grow by ``upper`` and somewhere are over ``driest``."""
    smooth = stored(smoothed_growth(flow, wvd, times))
    bent = frames.curvature_filter(wvd).withColumnRenamed("m", "bent")
    opened = morphology.grey_opening(smooth.withColumnRenamed("value", "v")).join(bent, KEY)
    opened = stored(opened.select(*KEY, (F.col("v") * F.col("bent").cast("double")).alias("g")))
    m = morphology.opening(opened.select(*KEY, F.coalesce(F.col("g") >= lower, F.lit(False)).alias("m")))
    found = tracking.flow_label(flow, stored(m), overlap, absolute).join(opened, KEY).join(wvd.select(*KEY, "v"), KEY)
    return smooth, labels.filter_labels(stored(found), min_length, [F.col("g") >= upper, F.col("v") >= driest]).select(*KEY, "label")


def growth_markers_multichannel(flow: DataFrame, wvd: DataFrame, bt: DataFrame, overlap: float = 0.5, absolute: int = 1, shrink: float = 0.0, min_length: int = 4, lower: float = 0.25, upper: float = 0.5, driest: float = -5.0, times: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The smoothed growth of both fields, and ``label``: regions that moisten or cool by ``lower`` per minute where the
    field bends, that last ``min_length`` steps and somewhere moisten and cool by ``upper`` and are over ``driest``."""
    w, b = stored(smoothed_growth(flow, wvd, times)), stored(smoothed_growth(flow, bt, times))
    both = w.withColumnRenamed("value", "w").join(b.withColumnRenamed("value", "b"), KEY).join(wvd.select(*KEY, "v"), KEY)
    bends = frames.curvature_filter(wvd).withColumnRenamed("m", "down").join(frames.curvature_filter(bt, direction="positive").withColumnRenamed("m", "up"), KEY)
    of = lambda value, where: F.col(value) * F.col(where).cast("double")
    grown = both.join(bends, KEY).select(*KEY, F.coalesce(of("w", "down") >= lower, F.lit(False)).alias("wet"), F.coalesce(of("b", "up") <= -lower, F.lit(False)).alias("cold"))
    m = morphology.opening(stored(grown.select(*KEY, (F.col("wet") | F.col("cold")).alias("m"))))
    found = tracking.flow_label(flow, stored(m), overlap, absolute, shrink).join(both, KEY)
    return w, b, labels.filter_labels(stored(found), min_length, [F.col("w") >= upper, F.col("b") <= -upper, F.col("v") > driest]).select(*KEY, "label")


def cooling(pixels: DataFrame, k: int, times: DataFrame | None = None) -> DataFrame:
    """``label, cooling``: the largest fall of a label's mean over ``k`` steps, per minute; 0 if it is too short."""
    seconds = stencil.time_steps(pixels, times).select("t") if times is None else times
    s = pixels.where(F.col("label") != 0).groupBy("label", "t").agg(F.avg("v").alias("v"))
    s = s.withColumn("s", F.col("t") * 60.0) if times is None else s.join(F.broadcast(seconds), "t").withColumnRenamed("seconds", "s")
    w = Window.partitionBy("label").orderBy("t")
    rate = (F.col("v") - F.lead("v", k).over(w)) / ((F.lead("s", k).over(w) - F.col("s")) / 60)
    return s.withColumn("r", rate).groupBy("label").agg(F.coalesce(F.max("r"), F.lit(0.0)).alias("cooling"))


def detect_cores(
    flow: DataFrame, bt: DataFrame, wvd: DataFrame | None = None, swd: DataFrame | None = None, bt_threshold: float = 0.5, wvd_threshold: float = 0.25, overlap: float = 0.5, absolute: int = 4, shrink: float = 0.0, min_length: int = 3, min_wvd: float = -5.0, min_cooling: float = 0.5, method: str = "cubic", use_filters: bool = True, times: DataFrame | None = None,
) -> DataFrame:
    """``label``: objects that cool (or moisten) fast, last longer than ``min_length`` steps, are not dry throughout, and
    cool by ``min_cooling`` K per minute over ``min_length`` steps."""
    filters = stored(combined_filter(flow, bt, wvd, swd)) if use_filters else None
    m = growth_mask(flow, bt, bt_threshold, filters, method, -1.0, times)
    if wvd is not None:
        other = growth_mask(flow, wvd, wvd_threshold, filters, method, 1.0, times).withColumnRenamed("m", "o")
        m = m.join(other, KEY).select(*KEY, (F.col("m") | F.col("o")).alias("m"))
    m = morphology.opening(stored(m))
    found = tracking.flow_label(flow, stored(m), overlap, absolute, shrink).join(bt.select(*KEY, "v"), KEY)
    masks = []
    if wvd is not None:
        found = found.join(wvd.select(*KEY, F.col("v").alias("wvd")), KEY)
        masks = [F.col("wvd") > min_wvd]
    found = stored(labels.filter_labels(stored(found), min_length, masks, strict=True))
    fast = cooling(found, min_length, times).where(F.col("cooling") >= min_cooling).select("label")
    return labels.remap(found, labels.numbered(fast, ["label"], "new_label")).select(*KEY, "label")


def anvil_markers(flow: DataFrame, field: DataFrame, threshold: float = -5.0, overlap: float = 0.5, absolute: int = 5, min_length: int = 3, shrink: float = 0.0) -> DataFrame:
    """``label``: regions at or over the threshold that last longer than ``min_length`` steps."""
    m = morphology.opening(field.select(*KEY, F.coalesce(F.col("v") >= threshold, F.lit(False)).alias("m")))
    return labels.filter_labels(stored(tracking.flow_label(flow, stored(m), overlap, absolute, shrink)), min_length, strict=True).select(*KEY, "label")


def edge_watershed(flow: DataFrame, field: DataFrame, markers: DataFrame, upper: float, lower: float, erode: int = 5, literal: bool = True, chunk: int | None = None) -> DataFrame:
    """``label``: markers flooded over the edges of a field clipped to two thresholds, opened. The background is where
    the field is at the lower one, eroded; floods go over it alone (the literal form) or over all but it."""
    marked = markers.select(*KEY, F.col("label").alias("marker"))
    clipped = stored(field.join(marked, KEY).select(*KEY, "marker", F.when(F.col("marker") != 0, F.lit(float(upper))).otherwise(F.greatest(F.least("v", F.lit(float(upper))), F.lit(float(lower)))).alias("v")))
    back = clipped.select(*KEY, F.coalesce(F.col("v") == lower, F.lit(False)).alias("m"))
    for _ in range(erode):
        back = morphology.erode(back, [o for o in stencil.full() if o[0] == 0], True)
    allowed = stored(back if literal else back.withColumn("m", ~F.col("m")))
    edges = stencil.sobel(clipped, flow, None, "nearest").select(*KEY, F.col("value").alias("v"))
    found = stored(flooding.watershed(flow, edges, markers, allowed, chunk))
    kept = morphology.opening(found.select(*KEY, (F.col("label") != 0).alias("m")))
    return found.join(kept, KEY).select(*KEY, F.when(F.col("m"), F.col("label")).otherwise(0).alias("label"))


def detect_anvils(flow: DataFrame, field: DataFrame, markers: DataFrame, upper: float = -5.0, lower: float = -15.0, erode: int = 1, min_length: int = 3, method: str = "cubic", chunk: int | None = None) -> DataFrame:
    """Markers flooded outwards over the edges of a field scaled between two thresholds; the background, where the
    scaled field is 0, floods against them. Objects that last longer than ``min_length`` and hold a marker stay."""
    markers = stored(markers)
    scaled = stored(field.select(*KEY, linearise(F.col("v"), lower, upper).alias("v")))
    core = morphology.erode(markers.select(*KEY, (F.col("label") != 0).alias("m")))
    back = morphology.watershed_mask(scaled, erode).withColumnRenamed("m", "b")
    seeds = markers.join(core, KEY).join(back, KEY).select(*KEY, F.when(F.col("b"), -1).when(F.col("m"), F.col("label")).otherwise(0).cast("int").alias("label"))
    edges = stencil.edge_field(scaled, flow, method).select(*KEY, F.col("value").alias("v"))
    basins = stored(flooding.watershed(flow, edges, seeds, None, chunk)).withColumn("label", F.greatest("label", F.lit(0)))
    kept = morphology.opening(basins.select(*KEY, (F.col("label") != 0).alias("m")))
    own = markers.select(*KEY, F.col("label").alias("marker"))
    out = basins.join(kept, KEY).join(own, KEY).withColumn("label", F.when(F.col("marker") != 0, F.col("marker")).when(F.col("m"), F.col("label")).otherwise(0))
    return labels.filter_labels(stored(out), min_length, [F.col("marker") != 0], strict=True).select(*KEY, "label")


def relabel_anvils(flow: DataFrame, anvils: DataFrame, markers: DataFrame | None = None, overlap: float = 0.5, absolute: int = 5, min_length: int = 3) -> DataFrame:
    """Anvils split into connected regions of each step and linked again; those with a marker stay."""
    steps = labels.split_components(anvils).select(*KEY, F.col("step_label").cast("int").alias("label"))
    linked = stored(tracking.link_overlap(flow, steps, overlap, absolute))
    if markers is None:
        return labels.filter_labels(linked, min_length, strict=True).select(*KEY, "label")
    both = linked.join(markers.select(*KEY, F.col("label").alias("marker")), KEY)
    return labels.filter_labels(both, min_length, [F.col("marker") != 0], strict=True).select(*KEY, "label")
