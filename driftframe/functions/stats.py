"""Aggregate expressions over label tables. NULL values take no part; every tie is broken by a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def wmean(v: Column, w: Column) -> Column:
    """Weighted mean of the non-null values; NULL where the weights sum to 0."""
    return F.sum(v * w) / F.nullif(F.sum(F.when(v.isNotNull(), w)), F.lit(0.0))


def with_centre(df: DataFrame, keys: list[str], v: str, w: str, name: str = "_mean") -> DataFrame:
    """The weighted mean of each group beside its rows: the first of the two passes that a stable deviation needs."""
    over = Window.partitionBy(*keys)
    total = F.sum(F.when(F.col(v).isNotNull(), F.col(w))).over(over)
    return df.withColumn(name, F.sum(F.col(v) * F.col(w)).over(over) / F.nullif(total, F.lit(0.0)))


def weighted_stats(df: DataFrame, keys: list[str], v: str, w: str, prefix: str = "", unbiased: bool = False) -> DataFrame:
    """``{prefix}mean, std, min, max`` for each group: population deviation, or divided by 1 - sum(w2) / sum(w)2
    where ``unbiased``. Extremes count only where the weight is positive; all NULL where weights sum to 0."""
    c = with_centre(df.where(F.col(v).isNotNull() & F.col(w).isNotNull()), keys, v, w)
    v, w = F.col(v), F.col(w)
    total, spread = F.sum(w), F.sum(w * (v - F.col("_mean")) * (v - F.col("_mean")))
    variance = spread / F.nullif(total, F.lit(0.0))
    if unbiased:
        variance = variance / F.nullif(1 - F.sum(w * w) / F.nullif(total * total, F.lit(0.0)), F.lit(0.0))
    valid = lambda c: F.when(F.sum(w) > 0, c)
    return c.groupBy(*keys).agg(
        F.first("_mean").alias(f"{prefix}mean"), F.sqrt(F.greatest(variance, F.lit(0.0))).alias(f"{prefix}std"),
        valid(F.min(F.when(w > 0, v))).alias(f"{prefix}min"), valid(F.max(F.when(w > 0, v))).alias(f"{prefix}max"),
    )


def weighted_uncertainty(e: Column, w: Column) -> Column:
    """sqrt(sum(w2 e2)) / sum(w)."""
    return F.sqrt(F.sum(w * w * e * e)) / F.nullif(F.sum(w), F.lit(0.0))


def weighted_stats_and_uncertainties(df: DataFrame, keys: list[str], v: str, e: str, w: str, prefix: str = "") -> DataFrame:
    """The four statistics (unbiased) and ``mean_uncertainty, mean_combined_error, min_error, max_error``."""
    rows = df.where(F.col(v).isNotNull() & F.col(e).isNotNull() & F.col(w).isNotNull())
    stats = weighted_stats(rows, keys, v, w, prefix, unbiased=True)
    order = lambda sign: F.struct(sign * F.col(v), F.col(e))
    errors = rows.groupBy(*keys).agg(
        weighted_uncertainty(F.col(e), F.col(w)).alias(f"{prefix}mean_uncertainty"), F.count(F.lit(1)).alias("_n"),
        F.min_by(e, order(1)).alias(f"{prefix}min_error"), F.min_by(e, order(-1)).alias(f"{prefix}max_error"),
    )
    combined = F.sqrt(F.col(f"{prefix}std") * F.col(f"{prefix}std") / F.col("_n") + F.col(f"{prefix}mean_uncertainty") * F.col(f"{prefix}mean_uncertainty"))
    return stats.join(errors, keys).withColumn(f"{prefix}mean_combined_error", combined).drop("_n")


def weighted_proportions(df: DataFrame, keys: list[str], flag: str, w: str) -> DataFrame:
    """``flag, proportion``: the share of the group's weight with each value of a flag."""
    sums = df.groupBy(*keys, flag).agg(F.sum(w).alias("_w"))
    whole = F.sum("_w").over(Window.partitionBy(*keys))
    return sums.select(*keys, flag, (F.col("_w") / F.nullif(whole, F.lit(0.0))).alias("proportion"))


def overlap_mode(v: Column, background: int = 0) -> Column:
    """The most frequent value but the background, the smallest on ties; the background if there is no other."""
    return F.coalesce(F.mode(F.when(v != background, v), True), F.lit(background))


def n_unique(v: Column) -> Column:
    """Distinct values other than 0."""
    return F.count_distinct(F.nullif(v, F.lit(0)))


def combined_mean(df: DataFrame, keys: list[str], mean: str, area: str) -> DataFrame:
    """Area-weighted mean of step means."""
    return df.groupBy(*keys).agg(wmean(F.col(mean), F.col(area)).alias("combined_mean"))


def combined_std(df: DataFrame, keys: list[str], std: str, mean: str, area: str, pooled: bool = False) -> DataFrame:
    """sqrt((sum(a s) + sum(a (m - M)2)) / sum(a)); with ``pooled``, s squared as pooling variances asks for."""
    c = with_centre(df, keys, mean, area)
    inner = F.col(std) * F.col(std) if pooled else F.col(std)
    d = F.col(mean) - F.col("_mean")
    return c.groupBy(*keys).agg(F.sqrt((F.sum(F.col(area) * inner) + F.sum(F.col(area) * d * d)) / F.nullif(F.sum(area), F.lit(0.0))).alias("combined_std"))


def strict_mean(v: Column, w: Column) -> Column:
    """Weighted mean that is NULL as soon as one value is."""
    return F.when(F.count(F.lit(1)) == F.count(v), wmean(v, w))


def arg_extreme(v: str, key: str, tie: str, largest: bool) -> Column:
    """``v`` at the largest or smallest ``key``, at the first ``tie`` on ties; NULL keys take no part."""
    at = F.struct(-F.col(key) if largest else F.col(key), F.col(tie))
    return F.min_by(v, F.when(F.col(key).isNotNull(), at))


def weighted_covariance(df: DataFrame, keys: list[str], x: str, y: str, w: str) -> DataFrame:
    """``cov, corr`` by weighted moments about the weighted means."""
    c = with_centre(with_centre(df, keys, x, w, "_x"), keys, y, w, "_y")
    dx, dy, w = F.col(x) - F.col("_x"), F.col(y) - F.col("_y"), F.col(w)
    cov, vx, vy = (F.sum(w * a * b) / F.nullif(F.sum(w), F.lit(0.0)) for a, b in ((dx, dy), (dx, dx), (dy, dy)))
    return c.groupBy(*keys).agg(cov.alias("cov"), (cov / F.nullif(F.sqrt(vx * vy), F.lit(0.0))).alias("corr"))


def mse(a: Column, b: Column) -> Column:
    d = a - b
    return F.sum(d * d) / F.nullif(F.count(d), F.lit(0))


def lag_rate(df: DataFrame, key: str, order: str, v: str, k: int = 1) -> DataFrame:
    """Per object, the largest fall of ``v`` over ``k`` steps per minute, and the step where it starts (``idx``)."""
    w = Window.partitionBy(key).orderBy(order)
    minutes = (F.lead(order, k).over(w) - F.col(order)) / 60
    rated = df.withColumn("_r", (F.col(v) - F.lead(v, k).over(w)) / F.nullif(minutes, F.lit(0.0)))
    return rated.groupBy(key).agg(F.coalesce(F.max("_r"), F.lit(0.0)).alias("rate"), F.min_by("step", F.when(F.col("_r").isNotNull(), F.struct(-F.col("_r"), F.col(order)))).alias("idx"))


def gradient(v: str, order: str, w: Window) -> Column:
    """Second-order derivative on a non-uniform axis, simple differences at the ends, NULL for a single row."""
    f, t = F.col(v), F.col(order)
    f0, f2, t0, t2 = F.lag(v).over(w), F.lead(v).over(w), F.lag(order).over(w), F.lead(order).over(w)
    hs, hd = t - t0, t2 - t
    inner = (hs * hs * f2 + (hd * hd - hs * hs) * f - hd * hd * f0) / F.nullif(hs * hd * (hs + hd), F.lit(0.0))
    return F.when(t0.isNull(), (f2 - f) / F.nullif(hd, F.lit(0.0))).when(t2.isNull(), (f - f0) / F.nullif(hs, F.lit(0.0))).otherwise(inner)


def bias_stats(df: DataFrame, obs: str, truth: str, w: str) -> DataFrame:
    """Bias, deviation, RMSE, correlation, count and least-squares line, plain and weighted: a one-row table."""
    o, t = F.col(obs), F.col(truth)
    plain = df.agg(
        F.avg(o - t).alias("bias"), F.stddev_pop(o - t).alias("std"), F.sqrt(F.avg((o - t) * (o - t))).alias("rmse"), F.corr(obs, truth).alias("r"),
        F.count(o - t).alias("n"), F.regr_slope(obs, truth).alias("slope"), F.regr_intercept(obs, truth).alias("intercept"),
        wmean(o - t, F.col(w)).alias("weighted_bias"), F.sqrt(wmean((o - t) * (o - t), F.col(w))).alias("weighted_rmse"),
    )
    return plain
