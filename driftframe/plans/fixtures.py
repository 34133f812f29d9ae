"""Pixel cubes, labels and step tables derived from the star-schema tables, in Spark and as DuckDB CTEs.

Pixels are rows ``t, y, x`` and values; missing values are NULL, never NaN; label 0 is background.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and columns of the cube.
HEIGHT, WIDTH = 20, 64
#: Its first and last row, first and last column; its last step may lack rows.
BOX = (0, HEIGHT - 1, 0, WIDTH - 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.floor(F.col("vec_id") / HEIGHT).cast("int").alias("t"), (F.col("vec_id") % HEIGHT).cast("int").alias("y"), F.posexplode("embedding").alias("x", "v")
    ).withColumn("v", F.col("v").cast("double"))


def holed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cube with NULL at every 13th pixel of a row sum."""
    return cube(spark, sf_dir).withColumn("v", F.when((F.col("x") + 3 * F.col("y") + F.col("t")) % 13 != 0, F.col("v")))


def flow(spark: SparkSession, sf_dir: str, scale: float = 1.0) -> DataFrame:
    c = cube(spark, sf_dir).select("t", "y", "x")
    fx, fy = ((F.col("t") + F.col("y")) % 3 - 1) * scale, ((F.col("t") + F.col("x")) % 3 - 1) * scale
    return c.select("t", "y", "x", fx.alias("fx"), fy.alias("fy"), (-fx).alias("bx"), (-fy).alias("by"))


def mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube(spark, sf_dir).select("t", "y", "x", (F.col("v") > 0.1).alias("m"))


def label(spark: SparkSession, sf_dir: str, shift: int = 0) -> DataFrame:
    x = F.col("x") + shift
    own = 1 + F.floor(F.col("y") / 5) * 4 + F.floor(x / 16)
    return cube(spark, sf_dir).withColumn("label", F.when(F.col("v") > 0, own).otherwise(0).cast("int"))


def area(y: str = "y"):
    return 1 + 0.01 * F.col(y)


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Object steps: user as core, event as step, value as brightness temperature."""
    e = table(spark, sf_dir, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select(
        F.col("user_id").alias("core"), F.col("event_id").alias("step"), (micros / 1e6).alias("t"), F.col("value").alias("bt"), (1 + F.col("event_id") % 7).cast("double").alias("area"),
    )


CUBE = f"""cube as (select (vec_id // {HEIGHT})::int as t, (vec_id % {HEIGHT})::int as y, x::int as x, embedding[x + 1]::double as v
  from (select vec_id, embedding, unnest(range({WIDTH})) as x from embeddings))"""
HOLED = CUBE + ", holed as (select t, y, x, case when (x + 3 * y + t) % 13 <> 0 then v end as v from cube)"
FLOW = CUBE + """, flow as (select t, y, x, (t + y) % 3 - 1 as fx, (t + x) % 3 - 1 as fy, 1 - (t + y) % 3 as bx, 1 - (t + x) % 3 as "by" from cube)"""
HALF = FLOW + """, half as (select t, y, x, 0.5 * fx as fx, 0.5 * fy as fy, 0.5 * bx as bx, 0.5 * "by" as "by" from flow)"""
MASK = CUBE + ", mask as (select t, y, x, v > 0.1 as m from cube)"
LABEL = CUBE + ", label as (select t, y, x, v, case when v > 0 then 1 + (y // 5) * 4 + x // 16 else 0 end::int as label from cube)"
LABELS2 = LABEL + ", label2 as (select t, y, x, v, case when v > 0 then 1 + (y // 5) * 4 + (x + 3) // 16 else 0 end::int as label from cube)"
STEPS = "steps as (select user_id as core, event_id as step, epoch_us(ts) / 1e6 as t, value as bt, (1 + event_id % 7)::double as area from events)"
