"""Command-line jobs over Parquet tables: ``python -m driftframe.plans.jobs detect|link|statistics|monthly|validate ...``.

Pixels are tables ``t, y, x`` with the channels or fields named; outputs are Parquet folders. Each job is a plan over
whole tables: files of a link job are rows of one table, not a loop.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftframe.operators import detection, entities, frames, incremental, labels, linking, stencil, validation
from driftframe.operators.stencil import KEY
from driftframe.session import session
from driftframe.sources import frames as source


@dataclass(frozen=True)
class Preset:
    """Parameters of a detection."""

    bt_growth: float
    wvd_growth: float
    absolute: int
    min_length: int
    thick: tuple[float, float]
    thin: tuple[float, float]
    overlap: float = 0.5
    erode: int = 2
    smoothing: int = 1


#: Thresholds of the three kinds of source.
PRESETS = {
    "goes": Preset(0.5, 0.25, 4, 3, (-5.0, -12.5), (0.0, -7.5)),
    "native": Preset(0.25, 0.25, 1, 2, (-5.0, -10.0), (0.0, -5.0)),
    "seviri": Preset(0.5, 0.25, 1, 1, (-5.0, -15.0), (0.0, -7.5)),
}


def detect(pixels: DataFrame, preset: Preset, flow: DataFrame | None = None, chunk: int | None = None) -> DataFrame:
    """``core, thick_anvil, thin_anvil`` labels of fields ``bt, wvd, swd``; the flow is worked out unless given."""
    field = lambda c: pixels.select(*KEY, c.alias("v"))
    bt, wvd, swd = F.col("bt"), F.col("wvd"), F.col("swd")
    flow = linking.stored(frames.optical_flow(field(bt), "dis", preset.smoothing, vr_steps=1) if flow is None else flow)
    cores = detection.detect_cores(flow, field(bt), field(wvd), field(swd), preset.bt_growth, preset.wvd_growth, preset.overlap, preset.absolute, min_length=preset.min_length)
    thick_field, thin_field = field(wvd - swd), field(wvd + swd)
    markers = detection.anvil_markers(flow, thick_field, preset.thick[0], preset.overlap, preset.absolute, preset.min_length)
    thick = linking.stored(detection.detect_anvils(flow, thick_field, markers, *preset.thick, preset.erode, preset.min_length, chunk=chunk))
    thin = detection.detect_anvils(flow, thin_field, thick, *preset.thin, preset.erode, preset.min_length, chunk=chunk)
    named = [df.withColumnRenamed("label", n) for df, n in ((cores, "core"), (thick, "thick_anvil"), (thin, "thin_anvil"))]
    return pixels.join(named[0], KEY).join(named[1], KEY).join(named[2], KEY)


def residual(field: DataFrame, flow: DataFrame, smoothing: int = 1) -> DataFrame:
    """Flow that is left between a step and the next one carried back to it: magnitude ``value`` of each pixel."""
    back = stencil.taps(field, flow, [(1, 0, 0)], "linear").select((F.col("t") * 2 + 1).alias("t"), "y", "x", F.col("value").alias("v"))
    pairs = field.select((F.col("t") * 2).alias("t"), "y", "x", "v").unionByName(back)
    f = frames.optical_flow(pairs, smoothing=smoothing).where("t % 2 = 0")
    return stencil.magnitude(f.withColumn("t", F.floor(F.col("t") / 2)))


def link(pixels: DataFrame, output: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Global labels of pixels of many files (``file``), neighbours merged, steps of each file kept once. ``output`` is
    given the merged pixels of all files and returns what is to be written of them."""
    linked = linking.relabel_files(pixels, linking.link_map(pixels))
    merged = linking.merge_neighbours(linking.stored(linked))
    return merged if output is None else output(linking.stored(merged))


def link_next(spark: SparkSession, table: str, file: str, pixels: DataFrame, output: str) -> str | None:
    """Add a file to a link table and write the one before it, which has both neighbours now, under ``output``; its name, or
    None for the first file. Labels are roots, so they stay unless a later file joins objects (``moves`` of the table)."""
    links = incremental.LinkTable(spark, table)
    before = links.last()
    links.add(file, pixels)
    if before is None:
        return None
    source.write(links.output(before["file"], "root").withColumn("file", F.lit(before["file"])), f"{output}/{before['file']}")
    return before["file"]


def monthly_statistics(steps: DataFrame, objects: DataFrame, key: str = "core") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Objects of linked files with merged flags, their steps, and the objects rolled up from those, all with ``month``."""
    flags, numbered = entities.combined_files(objects, steps, key)
    numbered = linking.stored(numbered.withColumn("ts", F.col("t")).withColumn("t", F.unix_micros(F.col("t").cast("timestamp")) / 1e6))
    rolled = entities.roll_up(numbered.drop("month", "ts"), key, key)
    return flags, numbered, rolled.join(flags.select(key, "month"), key)


def statistics(pixels: DataFrame, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """Steps with area-weighted statistics of fields, and the objects rolled up from them. ``pixels``: ``label, t, area``
    and positions and fields."""
    sliced = labels.slice_labels(pixels).where("label <> 0").withColumnRenamed("step_label", "step").withColumnRenamed("label", "core")
    steps, _ = entities.label_properties(sliced, "step", "core")
    from driftframe.functions.stats import weighted_stats

    for f in fields:
        steps = steps.join(weighted_stats(sliced, ["step"], f, "area", f"{f}_"), "step", "left")
    return steps, entities.core_properties(steps)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("job", choices=("detect", "link", "link-next", "statistics", "monthly", "validate"))
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--preset", default="goes", choices=sorted(PRESETS))
    p.add_argument("--chunk", type=int, help="steps flooded at once")
    p.add_argument("--fields", nargs="*", default=["bt"])
    p.add_argument("--objects", help="table file, core, edge, nan, start, end, parent of a monthly job; its input are the steps")
    p.add_argument("--events", help="table t, y, x, n of point events")
    p.add_argument("--table", help="folder of the link table that link-next adds its input to; its output is the file before, now complete")
    p.add_argument("--file", help="name of the file that link-next adds")
    p.add_argument("--margin", type=int, default=10)
    p.add_argument("--time-margin", type=int, default=3)
    a = p.parse_args(argv)
    run(session(), a)


def run(spark: SparkSession, a: argparse.Namespace) -> None:
    pixels = source.read(spark, a.input)
    if a.job == "detect":
        source.write(detect(source.goes_fields(pixels) if "C13" in pixels.columns else pixels, PRESETS[a.preset], chunk=a.chunk), a.output)
    elif a.job == "link":
        source.write(link(pixels), a.output, "file")
    elif a.job == "link-next":
        name = link_next(spark, a.table, a.file or a.input.rstrip("/").rsplit("/", 1)[-1], pixels, a.output)
        print(f"complete: {name}" if name else "first file")
    elif a.job == "statistics":
        steps, objects = statistics(pixels, a.fields)
        source.write(steps, f"{a.output}/steps")
        source.write(objects, f"{a.output}/objects")
    elif a.job == "monthly":
        for name, table in zip(("flags", "steps", "objects"), monthly_statistics(pixels, source.read(spark, a.objects)), strict=True):
            source.write(table, f"{a.output}/{name}", "month")
    else:
        events = source.read(spark, a.events)
        on_grid = pixels.select(*KEY).join(events, KEY, "left").select(*KEY, F.coalesce("n", F.lit(0)).alias("label"))
        inside = validation.edge_filter(pixels, a.margin, a.time_margin)
        near = lambda df: validation.cylinder_distance(df, a.time_margin)
        objects, summary = validation.validate(pixels, events, near(pixels), near(on_grid), inside, a.margin)
        source.write(objects, f"{a.output}/objects")
        source.write(summary, f"{a.output}/summary")


if __name__ == "__main__":
    main()
