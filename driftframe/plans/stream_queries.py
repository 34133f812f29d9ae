"""Streams: the same results as over tables, from files read as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftframe.plans import fixtures as fx
from driftframe.plans.label_queries import ARRIVING, arriving
from driftframe.plans.registry import query
from driftframe.sources.store import shared_folder
from driftframe.streaming import links, sessions

GAP = """g as (select user_id as core, ts, case when ts - lag(ts) over w >= interval 16 hours or lag(ts) over w is null then 1 else 0 end as new from events window w as (partition by user_id order by ts)),
s as (select *, sum(new) over (partition by core order by ts rows unbounded preceding) as object from g)"""


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = fx.table(spark, sf_dir, "events").schema
    s = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return s.select(F.col("user_id").alias("core"), F.col("ts").cast("timestamp").alias("ts"))


@query(f"with {GAP} select core, min(ts) as start, max(ts) as \"end\", count(*) as steps from s group by core, object")
def session_lifetimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lifetimes of objects that no gap of 16 hours interrupts."""
    s = sessions.lifetimes(fx.table(spark, sf_dir, "events").select(F.col("user_id").alias("core"), F.col("ts").cast("timestamp").alias("ts")), "core", "ts", "16 hours")
    return s.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query(f"with {GAP} select core, min(ts) as start, max(ts) as \"end\", count(*) as steps from s group by core, object")
def stream_lifetimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream."""
    out = sessions.drained(spark, sessions.lifetimes(_stream(spark, sf_dir), "core", "ts", "16 hours"), "complete")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("select event_id, ts + to_hours((event_id % 5)::int) as received, event_id % 5 > 2 as late from events")
def late_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps that came in more than two hours after their time."""
    e = fx.table(spark, sf_dir, "events").select("event_id", "ts", (F.col("ts") + F.make_dt_interval(F.lit(0), (F.col("event_id") % 5).cast("int"))).alias("received"))
    return sessions.flag_late(e, "ts", "received", "2 hours").select("event_id", "received", "late")


@query("select time_bucket(interval 6 hours, ts) as start, time_bucket(interval 6 hours, ts) + interval 6 hours as \"end\", count(*) as n from events group by 1, 2")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts in windows of six hours, from a stream."""
    out = sessions.drained(spark, sessions.tumbling(_stream(spark, sf_dir), "ts", "6 hours"), "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query(f"with {GAP} select core, epoch_us(ts) / 1e6 as t, object::bigint as object from s")
def stream_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects numbered by key with state kept between batches."""
    steps = _stream(spark, sf_dir).select("core", (F.unix_micros("ts") / 1e6).alias("t"))
    return sessions.drained(spark, sessions.carry_ids(steps, "core", 16 * 3600.0 - 1e-6))


@query("""with f as (select distinct date_trunc('day', ts) as file from events)
select file, event_id, ts >= file and ts < file + interval 1 day as inside from f join events on ts >= file - interval 3 hours and ts < file + interval 1 day + interval 3 hours""")
def stream_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of each day's file and of three hours on either side, from a stream of files and one of steps."""
    e = fx.table(spark, sf_dir, "events")
    listed, day = f"{shared_folder(spark)}/{uuid.uuid4().hex}", F.date_trunc("day", F.col("ts").cast("timestamp"))
    e.select(day.alias("file")).distinct().write.parquet(listed)
    days = spark.readStream.schema("file timestamp").parquet(listed)
    spans = days.select("file", F.col("file").alias("start"), (F.col("file") + F.expr("interval 1 day")).alias("end"))
    steps = spark.readStream.schema(e.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    out = sessions.drained(spark, links.padded(spans, steps.select("event_id", F.col("ts").cast("timestamp").alias("ts")), 3 * 3600.0, "40 days"))
    return out.select(F.col("file").cast("timestamp_ntz").alias("file"), "event_id", "inside")


@query(f"with recursive {ARRIVING} select f::bigint as file, label::bigint as label, global_label::int as global_label from map")
def stream_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Global labels from a stream of files, each meeting the labels that the state holds of the one before."""
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    for f, pixels in enumerate(arriving(spark, sf_dir)):  # in the order of their times
        pixels.select(F.lit(f).cast("long").alias("file"), "*", F.timestamp_seconds(F.col("t") * 600).alias("ts")).repartition(4).write.mode("append").parquet(folder)
    stream = spark.readStream.schema("file long, t int, y int, x int, label long, ts timestamp").option("maxFilesPerTrigger", 4).parquet(folder)
    with sessions.keyed_state(spark):
        counts = sessions.drained(spark, links.overlap_counts(stream, "1 hour", 86400.0))
    return links.links(counts)
