"""Labels in a moving frame: regions of each step, joined over time where they overlap along the flow."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftframe.operators import kernels
from driftframe.operators.frames import per_frame, streamed
from driftframe.operators.labels import numbered
from driftframe.operators.linking import ancestors, components, stored
from driftframe.operators.stencil import KEY, taps


def _global(local: DataFrame) -> DataFrame:
    """Numbers that count on from step to step: each step's offset is the sum of the regions before it."""
    counts = local.groupBy("t").agg(F.max("label").alias("n"))
    start = counts.select("t", F.coalesce(F.sum("n").over(Window.orderBy("t").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    return local.join(F.broadcast(start), "t").select(*KEY, F.when(F.col("label") > 0, F.col("label") + F.col("start")).otherwise(0).cast("int").alias("label"))


#: Rows and columns of a tile in which regions are found before they are joined over its borders.
TILE = 512


def tile_regions(mask: DataFrame, diagonal: bool = False, tile: int = TILE) -> tuple[DataFrame, tuple[int, int, int, int]]:
    """``t, y, x, part`` of the pixels of a mask: the place of the first pixel of the region within the tile, in the order of
    step, row and column; and the first row, first column, rows and columns that places are counted in."""
    b = mask.agg(*(f(c).alias(f"{c}{k}") for c in "yx" for k, f in ((0, F.min), (1, F.max)))).first()
    y0, x0 = (int(b[f"{c}0"] or 0) for c in "yx")
    height, width = (int(b[f"{c}1"] or 0) - o + 1 for c, o in (("y", y0), ("x", x0)))

    def run(rows: dict[str, np.ndarray]) -> list[np.ndarray]:
        t, y, x = (rows[c] for c in KEY)
        grid = np.zeros((y.max() - y.min() + 1, x.max() - x.min() + 1), bool)
        at = y - y.min(), x - x.min()
        grid[at] = True
        regions = kernels.components(grid, diagonal)[at]
        place = (int(t[0]) * height + y.astype(np.int64) - y0) * width + x - x0
        first = np.full(regions.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(first, regions, place)
        return [t, y, x, first[regions]]

    cell = lambda c, o: F.floor((F.col(c).cast("int") - o) / tile).alias(f"_{c}")
    own = mask.where(F.col("m")).select(*(F.col(c).cast("int").alias(c) for c in KEY), cell("y", y0), cell("x", x0))
    return streamed(own, ["t", "_y", "_x"], run, "t int, y int, x int, part long"), (y0, x0, height, width)


def flat_label(mask: DataFrame, diagonal: bool = False, tile: int = TILE) -> DataFrame:
    """``label``: connected regions of each step, numbered in the order of (t, first pixel).

    Regions are found in tiles of ``tile`` rows and columns; those that touch over a border of tiles are joined as
    components, so no task holds more of a frame than a tile. Only pixels beside borders take part in that.
    """
    parts, (y0, x0, _, _) = tile_regions(mask, diagonal, tile)
    parts = stored(parts)
    y, x = (F.pmod(F.col(c) - o, F.lit(tile)) for c, o in (("y", y0), ("x", x0)))
    rim = parts.where((y == 0) | (y == tile - 1) | (x == 0) | (x == tile - 1))
    offsets = [(0, 1), (1, 0), *([(1, 1), (1, -1)] if diagonal else [])]
    there = F.explode(F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in offsets)))
    led = rim.select("t", "y", "x", F.col("part").alias("src"), there.alias("o")).select("t", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"), "src")
    links = led.join(rim.withColumnRenamed("part", "dst"), KEY).where("src <> dst").select("src", "dst").distinct()
    roots = components(links).select(F.col("node").alias("part"), "root")
    rooted = parts.join(roots, "part", "left").withColumn("root", F.coalesce("root", "part"))
    named = rooted.join(numbered(rooted, ["root"], "_n"), "root").select(*KEY, "_n")
    return mask.select(*(F.col(c).cast("int").alias(c) for c in KEY)).join(named, KEY, "left").select(*KEY, F.coalesce("_n", F.lit(0)).alias("label"))


def subsegments(mask: DataFrame, shrink: float = 0.1, min_distance: int = 5) -> DataFrame:
    """Regions of each step split at their waists."""
    return _global(per_frame(mask.select(*KEY, F.col("m").cast("double").alias("label")), lambda a: kernels.subsegments(np.nan_to_num(a) > 0.5, shrink, min_distance), "label", "int"))


def flow_edges(flow: DataFrame, steps: DataFrame, overlap: float = 0.0, absolute: int = 1) -> DataFrame:
    """``src, dst, forward``: step labels that pixels of ``src`` lead to, more than ``absolute`` of them and at
    least ``overlap`` of the smaller label."""
    own = steps.where(F.col("label") != 0)
    led = taps(steps.withColumn("label", F.nullif("label", F.lit(0))), flow, [(1, 0, 0), (-1, 0, 0)], "nearest", "label")
    pairs = own.select(*KEY, F.col("label").alias("src")).join(led.where(F.col("value").isNotNull()), KEY)
    n = pairs.groupBy("src", F.col("value").alias("dst"), (F.col("tap") == 0).alias("forward")).agg(F.count(F.lit(1)).alias("n"))
    size = own.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    sized = n.join(size.select(F.col("label").alias("src"), F.col("size").alias("n_src")), "src").join(size.select(F.col("label").alias("dst"), F.col("size").alias("n_dst")), "dst")
    return sized.where((F.col("n") > absolute) & (F.col("n") >= overlap * F.least("n_src", "n_dst"))).select("src", "dst", "forward")


def link_overlap(flow: DataFrame, steps: DataFrame, overlap: float = 0.0, absolute: int = 0, undirected: bool = False) -> DataFrame:
    """Step labels (``label``) joined to objects.

    By default objects follow directed overlaps from the lowest label without an object, so a label belongs to the lowest
    one that leads to it; objects are numbered by theirs. ``undirected`` takes connected components.
    """
    steps = stored(steps)  # read for the links, their sizes and the result
    edges = flow_edges(flow, steps, overlap, absolute).select("src", "dst")
    every = steps.where(F.col("label") != 0).select("label").distinct()
    roots = (components(edges) if undirected else ancestors(edges)).withColumnRenamed("node", "label")
    rooted = every.join(roots, "label", "left").withColumn("root", F.coalesce("root", "label"))
    objects = rooted.join(numbered(rooted, ["root"], "object"), "root").select("label", "object")
    return steps.join(objects, "label", "left").select(*KEY, F.coalesce("object", F.lit(0)).alias("label"))


def flow_label(flow: DataFrame, mask: DataFrame, overlap: float = 0.0, absolute: int = 1, shrink: float = 0.0, min_distance: int = 5, undirected: bool = False) -> DataFrame:
    """Regions of each step, or their parts, linked over time."""
    steps = subsegments(mask, shrink, min_distance) if shrink else flat_label(mask)
    return link_overlap(flow, steps, overlap, absolute, undirected)
