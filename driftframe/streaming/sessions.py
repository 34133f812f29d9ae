"""Streams of object steps and point events: lifetimes by gap, windows, ids carried from batch to batch."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from driftframe.sources.store import shared_folder


def lifetimes(events: DataFrame, key: str, time: str, gap: str = "16 minutes", late: str | None = None) -> DataFrame:
    """``key, start, end, steps`` of sessions of an object that no gap of ``gap`` interrupts. On a stream, ``late`` is
    how long to wait for late steps; sessions come out once the watermark has passed them."""
    if late:
        events = events.withWatermark(time, late)
    s = events.groupBy(key, F.session_window(time, gap).alias("_w")).agg(F.count(F.lit(1)).alias("steps"), F.min(time).alias("start"), F.max(time).alias("end"))
    return s.select(key, "start", "end", "steps")


def tumbling(events: DataFrame, time: str, width: str = "5 minutes", slide: str | None = None, late: str | None = None) -> DataFrame:
    """Counts in windows of time, sliding if ``slide`` is given."""
    if late:
        events = events.withWatermark(time, late)
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return events.groupBy(w.alias("_w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "n")


def flag_late(events: DataFrame, time: str, received: str, allowed: str) -> DataFrame:
    """Steps that came in later than allowed, marked rather than dropped."""
    return events.withColumn("late", F.col(received) > F.col(time) + F.expr(f"interval {allowed}"))


def carry_ids(steps: DataFrame, key: str, gap_seconds: float = 960.0, forget_after: str | None = None, time: str = "ts") -> DataFrame:
    """``key, t, object``: each key's steps numbered by object, a new one after each gap, the number and the last time
    kept between batches. ``t`` is in seconds; rows of a batch are taken in order of time. A step that comes in a later
    batch than one after it belongs to the object of that batch's last step, however far back it is. With
    ``forget_after``, a watermark on the timestamp ``time``, the state of a key goes a gap after its last step, once the
    watermark is past that; should the key come again, its numbers start anew."""

    def run(k: tuple[Any, ...], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        number, last = state.get if state.exists else (0, float("-inf"))
        t = np.sort(np.concatenate([p["t"].to_numpy() for p in parts]))
        before = np.maximum(np.r_[last, t[:-1]], last)
        numbers = number + np.cumsum(t - before > gap_seconds)
        last = max(last, float(t[-1]))
        state.update((int(numbers[-1]), last))
        if forget_after:
            state.setTimeoutTimestamp(max(int((last + gap_seconds) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [k[0]] * len(t), "t": t, "object": numbers})

    if forget_after:
        steps = steps.withWatermark(time, forget_after)
    kept = [time] if forget_after else []
    return steps.select(F.col(key).cast("long").alias(key), F.col("t").cast("double").alias("t"), *kept).groupBy(key).applyInPandasWithState(
        run, f"{key} long, t double, object long", "number long, last double", "append", GroupStateTimeout.EventTimeTimeout if forget_after else GroupStateTimeout.NoTimeout
    )


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """States of many kinds need a store of column families; the session's own setting comes back afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def drained(spark: SparkSession, stream: DataFrame, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None, checkpoint: str | None = None) -> DataFrame:
    """What a stream gives when it has read all there is, as a table in the folder for checkpoints: all batches, or the
    last one of a stream in ``complete`` mode."""
    base = checkpoint or f"{shared_folder(spark)}/{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out" if mode == "complete" else f"{base}/out/batch={number}")
        if each:
            each(batch, number)

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out").select(*stream.columns)
