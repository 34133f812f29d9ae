"""Files as rows: names parsed for time, window and product, padding of a range, and lists of what not to read."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _day_of_year(stamp: Column) -> Column:
    """Seconds of ``YYYYDDDHHMMSSf``."""
    year = F.substring(stamp, 1, 4).cast("int")
    part = lambda at, n: F.substring(stamp, at, n).cast("long")
    start = F.unix_seconds(F.make_timestamp(year, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))
    return start + (part(5, 3) - 1) * 86400 + part(8, 2) * 3600 + part(10, 2) * 60 + part(12, 2)


def goes_time(name: Column) -> Column:
    """Midpoint of the scan that ``_sYYYYDDDHHMMSSf_eYYYYDDDHHMMSSf`` names, to the tenth of a second the name has."""
    tenths = lambda s: F.substring(s, 14, 1).cast("long")
    s, e = F.regexp_extract(name, r"_s(\d{14})", 1), F.regexp_extract(name, r"_e(\d{14})", 1)
    return F.timestamp_micros(F.floor((_day_of_year(s) + _day_of_year(e)) * 500_000 + (tenths(s) + tenths(e)) * 50_000).cast("long"))


def seviri_time(name: Column) -> Column:
    """Of level-2 files: the twelve characters 28 before the end."""
    return F.to_timestamp(F.substr(name, F.length(name) - 27, F.lit(12)), "yyyyMMddHHmm")


def native_time(name: Column) -> Column:
    """Of native files: characters 25 to 38."""
    return F.to_timestamp(F.substring(name, 25, 14), "yyyyMMddHHmmss")


def span(name: Column) -> tuple[Column, Column]:
    """Start and end of the window that ``_SyyyyMMdd_HHmmss`` and ``_E...`` name."""
    of = lambda c: F.to_timestamp(F.regexp_extract(name, rf"_{c}(\d{{8}}_\d{{6}})", 1), "yyyyMMdd_HHmmss")
    return of("S"), of("E")


def trim(df: DataFrame, start: Column, end: Column, time: str = "t") -> DataFrame:
    """Steps from ``start`` to a second before ``end``."""
    return df.where((F.col(time) >= start) & (F.col(time) <= end - F.expr("interval 1 second")))


def listing(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """``path, name, length, modificationTime`` of files, without reading them."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)
    return found.select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "length", "modificationTime")


def without(listed: DataFrame, corrupt: DataFrame, on: str = "name") -> DataFrame:
    """Files that aren't on the list of corrupt ones."""
    return listed.join(corrupt.select(on).distinct(), on, "left_anti")


def same_size(listed: DataFrame, manifest: DataFrame, rtol: float = 0.1, atol: float = 1.0) -> DataFrame:
    """Files whose size is within the tolerances of the manifest's ``size``."""
    both = listed.join(manifest.select("name", F.col("size").alias("_s")), "name")
    return both.where(F.abs(F.col("length") - F.col("_s")) <= atol + rtol * F.col("_s")).drop("_s")


def padded(listed: DataFrame, start: Column, end: Column, n_pad: int, time: str = "t") -> DataFrame:
    """Files of [start, end) with the last ``n_pad`` before and the first ``n_pad`` from the end on."""
    t = F.col(time)
    inside = listed.where((t >= start) & (t < end))
    before = listed.where(t < start).orderBy(t.desc()).limit(n_pad)
    after = listed.where(t >= end).orderBy(t.asc()).limit(n_pad)
    return before.unionByName(inside).unionByName(after)


def prefer(listed: DataFrame, first: str = ".nat", other: str = ".zip") -> DataFrame:
    """One file for each stem, the first suffix where both are there."""
    stem = F.regexp_replace("name", rf"({first}|{other})$".replace(".", r"\."), "")
    w = Window.partitionBy("_stem").orderBy((~F.endswith("name", F.lit(first))).cast("int"), "name")
    return listed.withColumn("_stem", stem).withColumn("_i", F.row_number().over(w)).where("_i = 1").drop("_stem", "_i")


def parameters(spark: SparkSession, **choices: Sequence) -> DataFrame:
    """All combinations of the values of parameters, to join listings with."""
    return spark.createDataFrame(list(product(*choices.values())), list(choices))
