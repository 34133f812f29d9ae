"""Channels to fields: derived quantities, joint masking, gaps in time, other views for missing steps, sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftframe.operators.stencil import KEY


def window(df: DataFrame, x0: int | None = None, x1: int | None = None, y0: int | None = None, y1: int | None = None) -> DataFrame:
    """Pixels of a box, ends excluded; as a filter it reaches the scan."""
    for name, low, high in (("x", x0, x1), ("y", y0, y1)):
        if low is not None:
            df = df.where(F.col(name) >= low)
        if high is not None:
            df = df.where(F.col(name) < high)
    return df


def stripe_deviation(df: DataFrame, value: str) -> DataFrame:
    """``t, y, stripe``: how far a row is from its columns on average, in their deviations."""
    w = Window.partitionBy("t", "x")
    z = (F.col(value) - F.avg(value).over(w)) / (F.stddev_pop(value).over(w) + 1e-8)
    return df.withColumn("_z", z).groupBy("t", "y").agg(F.abs(F.avg("_z")).alias("stripe"))


def fields(df: DataFrame, derived: dict[str, Column], flags: tuple[str, ...] = (), max_stripe: float | None = None, stripe_of: str | None = None) -> DataFrame:
    """``t, y, x`` and the derived fields, all NULL where one is missing or a flag is set, or in striped rows."""
    bad = F.lit(False)
    for c in flags:
        bad = bad | F.coalesce(F.col(c) != 0, F.lit(True))
    if max_stripe is not None:
        df = df.join(stripe_deviation(df, stripe_of or flags[0]), ["t", "y"])
        bad = bad | (F.col("stripe") > max_stripe)
    out = df.select(*KEY, bad.alias("_bad"), *(c.alias(n) for n, c in derived.items()))
    for n in derived:
        bad = F.col(n).isNull() | F.isnan(n)
        out = out.withColumn("_bad", F.col("_bad") | bad)
    return out.select(*KEY, *(F.when(~F.col("_bad"), F.col(n)).alias(n) for n in derived))


def goes_fields(df: DataFrame) -> DataFrame:
    """Window temperature, water-vapour and split-window differences of channels C08, C10, C13, C15."""
    flags = tuple(c for c in df.columns if c.startswith("DQF_"))
    return fields(df, {"bt": F.col("C13"), "wvd": F.col("C08") - F.col("C10"), "swd": F.col("C13") - F.col("C15")}, flags)


def seviri_fields(df: DataFrame) -> DataFrame:
    """The same of channels ch5, ch6, ch9, ch10."""
    return fields(df, {"bt": F.col("ch9"), "wvd": F.col("ch5") - F.col("ch6"), "swd": F.col("ch9") - F.col("ch10")})


def native_fields(df: DataFrame) -> DataFrame:
    """The same of native channels, with the positive part of the 8.7 - 12 µm difference."""
    d = F.col("IR_087") - F.col("IR_120")
    return fields(df, {"bt": F.col("IR_108"), "wvd": F.col("WV_062") - F.col("WV_073"), "twd": F.when(d.isNotNull(), F.greatest(d, F.lit(0.0)))})


def assert_unique_steps(files: DataFrame, time: str = "t") -> None:
    """Raises if two files have the same time."""
    twice = files.groupBy(time).count().where("count > 1").first()
    if twice is not None:
        raise ValueError(f"duplicate time {twice[time]}")


def fill_gaps(df: DataFrame, seconds: DataFrame, gap: float) -> DataFrame:
    """An empty step in the middle of each gap longer than ``gap``. ``df``: pixels by ``s``; ``seconds``: its steps."""
    w = Window.orderBy("s")
    holes = seconds.select("s").distinct().withColumn("_n", F.lead("s").over(w)).where(F.col("_n") - F.col("s") > gap).select(((F.col("s") + F.col("_n")) / 2).alias("s"))
    grid = df.select("y", "x").distinct()
    empty = grid.join(F.broadcast(holes))  # a few steps by one grid
    return df.unionByName(empty, allowMissingColumns=True)


def splice(df: DataFrame, other: DataFrame, dy: int = 0, dx: int = 0, time: str = "s") -> DataFrame:
    """Steps of another view, shifted onto this grid, where this view has none."""
    missing = other.join(df.select(time).distinct(), time, "left_anti")
    box = F.broadcast(df.agg(F.min("y").alias("_y0"), F.max("y").alias("_y1"), F.min("x").alias("_x0"), F.max("x").alias("_x1")))
    moved = missing.withColumns({"y": F.col("y") - dy, "x": F.col("x") - dx}).join(box, (F.col("y").between(F.col("_y0"), F.col("_y1"))) & (F.col("x").between(F.col("_x0"), F.col("_x1"))))
    return df.unionByName(moved.select(*df.columns))


def read(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Pixels from Parquet, NaN as NULL; only the wanted columns that exist are read."""
    df = spark.read.parquet(path)
    wanted = df.columns if columns is None else [c for c in columns if c in df.columns]
    kinds = dict(df.dtypes)
    return df.select(*(F.when(~F.isnan(c), F.col(c)).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in wanted))


def write(df: DataFrame, path: str, by: str | None = None, codec: str = "zstd") -> None:
    """Parquet by the commit protocol, so a failed job leaves nothing half written."""
    w = df.write.option("compression", codec)
    (w.partitionBy(by) if by else w).parquet(path)


def described(df: DataFrame, name: str, **attributes: str) -> DataFrame:
    """Attributes (units, long name) on a column."""
    return df.withMetadata(name, attributes)
