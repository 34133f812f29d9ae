"""Scaling of fields. Each method is a DataFrame operation over groups (a frame, or a pair of frames)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clamp(v: Column, low: float, high: float) -> Column:
    """Within [low, high]; NULL stays NULL (``greatest`` alone would skip it)."""
    return F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(low)), F.lit(high)))


def linearise(v: Column, lower: float, upper: float) -> Column:
    """0 to 1 between two thresholds; falling if the first is the larger."""
    if lower == upper:
        raise ValueError("thresholds must differ")
    if lower > upper:
        return 1 - linearise(v, upper, lower)
    return clamp((v - lower) / (upper - lower), 0.0, 1.0)


def _scaled(v: Column, low: Column, high: Column) -> Column:
    factor = F.when(high == low, F.lit(0.0)).otherwise(1 / F.nullif(high - low, F.lit(0.0)))
    return clamp((v - low) * factor, 0.0, 1.0)


def linear_norm(df: DataFrame, keys: list[str], value: str = "v", low: float | None = None, high: float | None = None) -> DataFrame:
    w = Window.partitionBy(*keys)
    lo = F.min(value).over(w) if low is None else F.lit(float(low))
    hi = F.max(value).over(w) if high is None else F.lit(float(high))
    return df.withColumn(value, _scaled(F.col(value), lo, hi))


def log_norm(df: DataFrame, keys: list[str], value: str = "v", fixed: bool = False) -> DataFrame:
    """Scaling of log(v - min + 1). The lower end is the minimum before the logarithm, unless ``fixed``."""
    w = Window.partitionBy(*keys)
    least = F.min(value).over(w)
    df = df.withColumns({"_lo": least, "_l": F.log(F.col(value) - least + 1)})
    low = F.min("_l").over(w) if fixed else F.col("_lo")
    return df.withColumn(value, _scaled(F.col("_l"), low, F.max("_l").over(w))).drop("_lo", "_l")


def inverse_log_norm(df: DataFrame, keys: list[str], value: str = "v", fixed: bool = False) -> DataFrame:
    """Scaling of log(max - v + 1). The upper end is the maximum before the logarithm, unless ``fixed``."""
    w = Window.partitionBy(*keys)
    most = F.max(value).over(w)
    df = df.withColumns({"_hi": most, "_l": F.log(most - F.col(value) + 1)})
    high = F.max("_l").over(w) if fixed else F.col("_hi")
    return df.withColumn(value, _scaled(F.col("_l"), F.min("_l").over(w), high)).drop("_hi", "_l")


def z_norm(df: DataFrame, keys: list[str], value: str = "v", max_std: float = 3.0) -> DataFrame:
    w = Window.partitionBy(*keys)
    z = (F.col(value) - F.avg(value).over(w)) / F.nullif(F.stddev_pop(value).over(w), F.lit(0.0))
    return df.withColumn(value, clamp((z + max_std) / (2 * max_std), 0.0, 1.0))


def uniform_norm(df: DataFrame, keys: list[str], value: str = "v", quantiles: int = 256) -> DataFrame:
    """Scaled number of the quantile bin: how many of the exact quantile edges lie at or below the value, the
    last edge moved up by one so that the maximum falls into the last bin."""
    shares = [i / quantiles for i in range(quantiles + 1)]
    edges = df.groupBy(*keys).agg(F.percentile(value, shares).alias("_e"))
    binned = df.join(edges, keys).withColumn(value, F.when(F.col(value).isNotNull(), F.least(F.size(F.filter("_e", lambda e: e <= F.col(value))), F.lit(quantiles)).cast("double"))).drop("_e")
    return linear_norm(binned, keys, value)


def local_linear_norm(df: DataFrame, keys: list[str], value: str = "v", size: int = 100, tile: int = 512) -> DataFrame:
    """Scaling by the extremes of a square of ``size`` pixels around each, cut off at the border; missing values count as the
    mean of the frame (``keys``), pixels without a row as nothing. Each pixel goes to the tiles of ``tile`` rows and columns
    whose squares it lies in, so a task holds a tile and its surroundings, not a frame."""
    from driftframe.operators.kernels import sliding

    before, after = size // 2, size - 1 - size // 2
    names = [*keys, "y", "x"]
    kinds = {f.name: f.dataType.simpleString() for f in df.select(*names).schema}
    # a square reaches ``before`` pixels up and left, so a pixel counts for tiles that end as far after it, and begin ``after`` before
    near = lambda c: F.explode(F.sequence(F.floor((F.col(c) - after) / tile), F.floor((F.col(c) + before) / tile)))
    means = df.groupBy(*keys).agg(F.avg(value).alias("_mean"))
    own = df.select(*names, F.col(value).cast("double").alias("_v"))
    around = own.withColumn("_ty", near("y")).withColumn("_tx", near("x")).join(means, keys)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        y, x, mean = part["y"].to_numpy(), part["x"].to_numpy(), part["_mean"].iloc[0]
        mean = 0.0 if pd.isna(mean) else float(mean)
        at = y - y.min(), x - x.min()
        a, there = (np.full((at[0].max() + 1, at[1].max() + 1), fill) for fill in (np.nan, False))
        a[at], there[at] = part["_v"].to_numpy(dtype=float, na_value=np.nan), True
        v = np.where(np.isfinite(a), a, mean)
        low, high = (sliding(np.where(there, v, worst), size, f)[at] for worst, f in ((np.inf, np.minimum), (-np.inf, np.maximum)))
        spread = np.where(high > low, high - low, 1.0)
        mine = (y // tile == part["_ty"].to_numpy()) & (x // tile == part["_tx"].to_numpy())
        return part[names].assign(_new=np.where(high > low, (v[at] - low) / spread, 0.0))[mine]

    schema = ", ".join(f"{n} {kinds[n]}" for n in names) + ", _new double"
    found = around.groupBy(*keys, "_ty", "_tx").applyInPandas(run, schema)
    rest = [c for c in df.columns if c not in (*names, value)]
    scaled = found.select(*names, F.col("_new").alias(value))
    return df.select(*names, *rest).join(scaled, names).select(*df.columns) if rest else scaled.select(*df.columns)


METHODS: dict[str, Callable[..., DataFrame]] = {
    "linear": linear_norm, "log": log_norm, "inverse_log": inverse_log_norm, "z_score": z_norm, "uniform": uniform_norm, "local_linear": local_linear_norm,
}


def method(name: str) -> Callable[..., DataFrame]:
    if name not in METHODS:
        raise ValueError(f"{name} is none of {sorted(METHODS)}")
    return METHODS[name]


def to_8bit(df: DataFrame, keys: list[str], value: str = "v", low: float | None = None, high: float | None = None, fill: int = 127) -> DataFrame:
    """Truncated to 0..255 between the extremes of each group; ``fill`` for missing values."""
    w = Window.partitionBy(*keys)
    lo = F.min(value).over(w) if low is None else F.lit(float(low))
    hi = F.max(value).over(w) if high is None else F.lit(float(high))
    factor = F.when(hi == lo, F.lit(0.0)).otherwise(255 / F.nullif(hi - lo, F.lit(0.0)))
    return df.withColumn(value, F.coalesce(F.floor((F.col(value) - lo) * factor), F.lit(fill)).cast("int"))
