"""Algebra of label cubes: renumbering, remapping, lengths, masks, overlaps and cascades over entity tables.

Numbers are given to the table of distinct labels, bucket by bucket of its first key, and carried to the pixels by
a join; only the buckets' counts are ordered as a whole.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftframe.operators.stencil import KEY


#: Labels of so many consecutive numbers (a power of 2) are ordered by one task.
BUCKET_BITS = 16


def numbered(labels: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """The distinct ``by`` (whole numbers) with contiguous numbers from 1 in their order."""
    own = labels.select(*by).distinct()
    first = F.col(by[0]).cast("long")
    own = own.withColumn("_b", first if len(by) > 1 else F.shiftright(first, BUCKET_BITS))
    counts = own.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_b", F.coalesce(before, F.lit(0)).alias("_s"))
    rank = F.row_number().over(Window.partitionBy("_b").orderBy(*by))
    return own.join(starts, "_b").select(*by, (F.col("_s") + rank).cast("int").alias(name))


def slice_labels(pixels: DataFrame, label: str = "label") -> DataFrame:
    """``step_label``: one number for each (t, label), in that order; 0 for background."""
    steps = numbered(pixels.where(F.col(label) != 0), ["t", label], "step_label")
    return pixels.join(steps, ["t", label], "left").withColumn("step_label", F.coalesce("step_label", F.lit(0)))


def relabel(pixels: DataFrame, label: str = "label") -> DataFrame:
    """Contiguous numbers in ascending order of the old ones; 0 stays."""
    new = numbered(pixels.where(F.col(label) != 0), [label], "_new")
    return pixels.join(new, label, "left").withColumn(label, F.coalesce("_new", F.lit(0))).drop("_new")


def remap(pixels: DataFrame, mapping: DataFrame, label: str = "label", new: str = "new_label") -> DataFrame:
    """Labels by a table ``label, new_label``; those that it lacks become 0."""
    return pixels.join(mapping, label, "left").withColumn(label, F.coalesce(new, F.lit(0)).cast("int")).drop(new)


def lengths(pixels: DataFrame, label: str = "label", axis: str = "t") -> DataFrame:
    """Extent along an axis, gaps counted."""
    return pixels.where(F.col(label) != 0).groupBy(label).agg((F.max(axis) - F.min(axis) + 1).alias("length"))


def mask_labels(pixels: DataFrame, mask: Column, label: str = "label") -> DataFrame:
    """Whether any pixel of each label lies in a mask."""
    return pixels.where(F.col(label) != 0).groupBy(label).agg(F.coalesce(F.bool_or(mask), F.lit(False)).alias("inside"))


def filter_labels(pixels: DataFrame, min_length: int = 0, masks: Sequence[Column] = (), label: str = "label", strict: bool = False) -> DataFrame:
    """Labels that extend over ``min_length`` steps (more, if ``strict``) and touch each mask, renumbered; the
    others become 0."""
    extent = F.max("t") - F.min("t") + 1
    found = pixels.where(F.col(label) != 0).groupBy(label).agg(extent.alias("_n"), *(F.coalesce(F.bool_or(m), F.lit(False)).alias(f"_m{i}") for i, m in enumerate(masks)))
    keep = F.col("_n") > min_length if strict else F.col("_n") >= min_length
    for i in range(len(masks)):
        keep = keep & F.col(f"_m{i}")
    kept = numbered(found.where(keep), [label], "new_label")
    return remap(pixels, kept, label)


def steps_of(pixels: DataFrame, label: str = "label", step: str = "step_label") -> DataFrame:
    """The step labels of each label, ascending."""
    return pixels.where((F.col(label) != 0) & (F.col(step) != 0)).groupBy(label).agg(F.sort_array(F.collect_set(step)).alias("steps"))


def step_parents(pixels: DataFrame, step: str = "step_label", label: str = "label") -> DataFrame:
    """The label that most pixels of each step label have, the smallest on ties; 0 only if they have no other."""
    from driftframe.functions.stats import overlap_mode

    return pixels.where(F.col(step) != 0).groupBy(step).agg(overlap_mode(F.col(label)).alias("parent"))


def overlap_counts(a: DataFrame, b: DataFrame, label: str = "label") -> DataFrame:
    """``a, b, n, n_a, n_b``: shared pixels of labels of two cubes on the same grid, and their sizes."""
    left = a.where(F.col(label) != 0).select(*KEY, F.col(label).alias("a"))
    right = b.where(F.col(label) != 0).select(*KEY, F.col(label).alias("b"))
    n = left.join(right, KEY).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    return n.join(left.groupBy("a").agg(F.count(F.lit(1)).alias("n_a")), "a").join(right.groupBy("b").agg(F.count(F.lit(1)).alias("n_b")), "b")


def overlaps(a: DataFrame, b: DataFrame, overlap: float = 0.0, absolute: int = 0, strict: bool = True, label: str = "label") -> DataFrame:
    """Pairs that share more than ``absolute`` pixels (at least, unless ``strict``) and at least ``overlap`` of the
    smaller one."""
    counts = overlap_counts(a, b, label)
    enough = F.col("n") > absolute if strict else (F.col("n") >= max(absolute, 1))
    return counts.where(enough & (F.col("n") >= overlap * F.least("n_a", "n_b")))


def max_overlap(a: DataFrame, b: DataFrame, atol: int = 5, label: str = "label") -> DataFrame:
    """``a, b``: for each label of ``a`` the one of ``b`` it shares most pixels with, the smallest on ties; 0
    where fewer than ``atol`` are shared."""
    counts = overlap_counts(a, b, label)
    best = counts.groupBy("a").agg(F.min_by("b", F.struct(-F.col("n"), F.col("b"))).alias("b"), F.max("n").alias("n"))
    every = a.where(F.col(label) != 0).select(F.col(label).alias("a")).distinct()
    return every.join(best, "a", "left").select("a", F.when(F.col("n") >= atol, F.col("b")).otherwise(F.lit(0)).alias("b"))


def link_cores_and_anvils(cores: DataFrame, anvils: DataFrame, atol: int = 5) -> tuple[DataFrame, DataFrame]:
    """``core, anvil`` by most overlap, and the anvil cube with the pixels of linked cores written into it."""
    index = max_overlap(cores, anvils, atol).select(F.col("a").alias("core"), F.col("b").alias("anvil"))
    mine = cores.select(*KEY, F.col("label").alias("core")).join(index, "core", "left").select(*KEY, F.nullif("anvil", F.lit(0)).alias("_a"))
    merged = anvils.join(mine, KEY, "left").withColumn("label", F.coalesce("_a", "label")).drop("_a")
    return index, merged


def fill_from(own: DataFrame, other: DataFrame, label: str = "label") -> DataFrame:
    """Zeros of one cube filled from another."""
    o = other.select(*KEY, F.col(label).alias("_o"))
    return own.join(o, KEY, "left").withColumn(label, F.coalesce(F.nullif(label, F.lit(0)), "_o", F.lit(0))).drop("_o")


def split_components(frames: DataFrame, label: str = "label") -> DataFrame:
    """``step_label``: connected regions of each step, further split by label, numbered in the order of (t, first
    pixel, label). The regions come from a kernel over dense frames."""
    from driftframe.operators.tracking import flat_label

    regions = flat_label(frames.select(*KEY, (F.col(label) != 0).alias("m"))).withColumnRenamed("label", "_r")
    both = frames.join(regions, KEY)
    new = numbered(both.where(F.col(label) != 0), ["_r", label], "step_label")
    return both.join(new, ["_r", label], "left").withColumn("step_label", F.coalesce("step_label", F.lit(0))).drop("_r")


def apply_to_labels(pixels: DataFrame, keys: Sequence[str], aggregate: Column, index: DataFrame | None = None, default: object = None) -> DataFrame:
    """An aggregate for each label as ``value`` (several, if it is a struct). ``index`` names the labels wanted;
    those without pixels have ``default``."""
    got = pixels.groupBy(*keys).agg(aggregate.alias("value"))
    if index is None:
        return got
    joined = index.select(*keys).join(got, list(keys), "left")
    return joined if default is None else joined.withColumn("value", F.coalesce("value", F.lit(default)))


def apply_with_positions(pixels: DataFrame, keys: Sequence[str], f: Callable[[pd.DataFrame], dict[str, object]], returns: str) -> DataFrame:
    """What ``f`` makes of the rows of each label, places and values together and in the order of places: the columns
    ``returns`` (DDL). A task holds the rows of one label, so an aggregate expression is better where there is one."""
    names = [*keys, *(c.split()[0] for c in returns.split(","))]

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{**dict(zip(keys, key, strict=True)), **f(part.sort_values(KEY, kind="stable"))}])[names]

    types = {c.name: c.dataType.simpleString() for c in pixels.schema}
    return pixels.groupBy(*keys).applyInPandas(run, ", ".join([*(f"{k} {types[k]}" for k in keys), returns]))
