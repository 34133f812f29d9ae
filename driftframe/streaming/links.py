"""Linking on streams: files that meet the steps around them, and labels carried from file to file by overlap.

``padded`` joins two streams, the spans of files and the steps, on an interval of event time: each side waits for the
other only as long as its watermark says. ``overlap_counts`` keeps the labels of the last file of every block of steps of
every tile of the grid in a map state by step and counts the pixels that labels of the next file share with them; timers
drop the state of blocks that no longer get rows. Counts are sums over blocks, so an object that spans them needs no block
to see it whole, a small grid over many steps is many blocks, and ``links`` closes them into the same global labels as ``linking.link_map`` gives for all files at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from driftframe.operators import labels
from driftframe.operators.linking import components

#: Rows and columns of a tile, and steps of a block of it.
TILE, STEPS = 64, 32

COUNTS = "kind string, file long, next long, t int, a long, b long, n long"


def padded(files: DataFrame, steps: DataFrame, pad_seconds: float, late: str, slot_seconds: float = 3600.0) -> DataFrame:
    """``file`` and all columns of ``steps`` (with a timestamp ``ts``) for each step from ``pad_seconds`` before ``start`` to as
    long after ``end`` (without) of a file (``file, start, end``), with ``inside``, whether the file itself spans it. Streams
    or tables; on streams both sides wait for rows up to ``late`` behind the newest; what comes later may meet nothing.
    Time is cut into slots of ``slot_seconds``, so that rows meet by equal slots."""
    f, s = files.select("file", "start", "end"), steps
    if files.isStreaming and steps.isStreaming:
        f, s = f.withWatermark("start", late), s.withWatermark("ts", late)
    width = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(pad_seconds))
    slot = lambda c: F.floor(F.unix_micros(c) / int(slot_seconds * 1e6))
    f = f.withColumn("_slot", F.explode(F.sequence(slot(F.col("start") - width), slot(F.col("end") + width))))
    # both bounds also tell the state of either side when a row can meet nothing more
    met = f.join(s.withColumn("_s", slot(F.col("ts"))), (F.col("_slot") == F.col("_s")) & (F.col("ts") >= F.col("start") - width) & (F.col("ts") < F.col("end") + width))
    return met.withColumn("inside", (F.col("ts") >= F.col("start")) & (F.col("ts") < F.col("end"))).drop("start", "end", "_slot", "_s")


def _tallied(keys: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Distinct rows of columns, and how often each occurs."""
    found, n = np.unique(np.stack(keys), axis=1, return_counts=True)
    return (*found, n)


class Overlaps(StatefulProcessor):
    """State of a block of steps of a tile: ``files``, the file that is being read and the time of its last row; ``now`` and ``before``, the
    labelled pixels of that file and the one before it, by step."""

    def __init__(self, forget_ms: int | None = None):
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.files = handle.getValueState("files", "file long, before long, ms long")
        arrays = "y array<int>, x array<int>, label array<long>"
        self.now, self.before = handle.getMapState("now", "t int", arrays), handle.getMapState("before", "t int", arrays)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        part = pd.concat(list(rows))
        file, before, ms = self.files.get() if self.files.exists() else (None, None, 0)
        out = []
        for f, own in part.groupby("file", sort=True):
            f = int(f)
            if file is not None and f < file:  # counted, but no longer linked
                out.append(self._table("late", f, None, own["t"].to_numpy(), own["label"].to_numpy()))
                continue
            if f != file:
                self._turn()
                file, before = f, file
            out += self._met(own, f, before)
            ms = max(ms, int(own["ms"].max()))
        self.files.update((file, before, ms))
        if self.forget_ms is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(max(ms + self.forget_ms, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.concat(out) if out else self._table("late", 0, None, np.zeros(0, int), np.zeros(0, int))

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.files, self.now, self.before):
            state.clear()
        yield self._table("late", 0, None, np.zeros(0, int), np.zeros(0, int))

    def _turn(self) -> None:
        """What was read is now the file before."""
        self.before.clear()
        for k, v in self.now.iterator():
            self.before.updateValue(k, v)
        self.now.clear()

    def _met(self, own: pd.DataFrame, file: int, before: int | None) -> list[pd.DataFrame]:
        """Sizes of the labels of rows, background included, and what they share with the file before; the rows are kept."""
        out = [self._table("size", file, None, own["t"].to_numpy(), own["label"].to_numpy())]
        for t, step in own[own["label"] != 0].groupby("t", sort=True):
            k, place = (int(t),), [step["y"].to_numpy(), step["x"].to_numpy(), step["label"].to_numpy()]
            if before is not None and self.before.containsKey(k):
                old = pd.DataFrame(dict(zip(("y", "x", "a"), self.before.getValue(k), strict=True)))
                both = step.merge(old, on=["y", "x"])
                if len(both):
                    out.append(self._table("pair", before, file, np.full(len(both), t), both["a"].to_numpy(), both["label"].to_numpy()))
            if self.now.containsKey(k):
                place = [np.r_[p, q] for p, q in zip(self.now.getValue(k), place, strict=True)]
            self.now.updateValue(k, tuple(p.tolist() for p in place))
        return out

    @staticmethod
    def _table(kind: str, file: int, following: int | None, t: np.ndarray, a: np.ndarray, b: np.ndarray | None = None) -> pd.DataFrame:
        *found, n = _tallied([t, a] if b is None else [t, a, b])
        return pd.DataFrame({
            "kind": kind, "file": file, "next": pd.array([following] * len(n), "Int64"), "t": found[0], "a": found[1],
            "b": pd.array([None] * len(n) if b is None else found[2], "Int64"), "n": n,
        })

    def close(self) -> None:
        pass


def overlap_counts(pixels: DataFrame, late: str | None = None, forget_seconds: float | None = None, tile: int = TILE, steps: int = STEPS) -> DataFrame:
    """Counts from a stream of pixels of files (``file`` ascending, ``t, y, x, label`` and the time ``ts`` of the step).

    Of ``kind`` ``size``: ``n`` pixels of label ``a`` in a step of a file, background included. Of ``pair``: pixels of a step
    that are ``a`` in ``file`` and ``b`` in ``next``. A file's rows may come in several batches, but before those of the next
    one; rows of an older file than the last one of their block are counted as ``late`` and not linked. With ``late`` and
    ``forget_seconds`` rows behind the watermark are left out, and a block forgets its labels once the watermark is so far
    past its last row. A block has ``steps`` steps of a tile of ``tile`` rows and columns.
    """
    own = pixels.withWatermark("ts", late) if late else pixels
    keys = [F.floor(F.col(c) / n).alias(f"_{c}") for c, n in (("t", steps), ("y", tile), ("x", tile))]
    cast = {"file": "long", "t": "int", "y": "int", "x": "int", "label": "long"}
    own = own.select(*keys, *(F.col(c).cast(k).alias(c) for c, k in cast.items()), "ts", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    timed = forget_seconds is not None
    processor = Overlaps(int(forget_seconds * 1000) if timed else None)
    return own.groupBy("_t", "_y", "_x").transformWithStateInPandas(processor, COUNTS, "Append", "EventTime" if timed else "None")


def links(counts: DataFrame, atol: int = 5, rtol: float = 0.5) -> DataFrame:
    """``file, label, global_label`` from the counts of a stream, as ``linking.link_map`` for all files at once."""
    sizes = counts.where("kind = 'size'").groupBy("file", "t", "a").agg(F.sum("n").alias("n"))
    after = counts.where("kind = 'size'").select("file").distinct()
    files = after.agg(F.sort_array(F.collect_set("file")).alias("f")).select(F.explode(F.arrays_zip(F.col("f"), F.slice("f", 2, F.size("f")).alias("g"))).alias("z"))
    files = files.select(F.col("z.f").alias("file"), F.col("z.g").alias("next")).where("next is not null")  # one row for each file
    steps = sizes.select("file", "t").distinct()
    common = steps.join(files, "file").join(steps.select(F.col("file").alias("next"), "t"), ["next", "t"])
    span = common.groupBy("file", "next").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    inner = common.join(span, ["file", "next"]).where((F.col("t") > F.col("lo")) & (F.col("t") < F.col("hi"))).select("file", "next", "t")
    na = sizes.join(inner, ["file", "t"]).groupBy("file", "a").agg(F.sum("n").alias("na"))
    nb = sizes.withColumnsRenamed({"file": "next", "a": "b"}).join(inner, ["next", "t"]).groupBy("next", "b").agg(F.sum("n").alias("nb"))
    met = counts.where("kind = 'pair'").join(inner, ["file", "next", "t"]).groupBy("file", "next", "a", "b").agg(F.sum("n").alias("n"))
    e = met.join(na, ["file", "a"]).join(nb, ["next", "b"]).where((F.col("n") >= max(atol, 1)) & (F.col("n") >= rtol * F.least("na", "nb")))
    ids = labels.numbered(sizes.where("a <> 0"), ["file", "a"], "id")
    of = lambda side, name, new: ids.select(F.col("file").alias(side), F.col("a").alias(name), F.col("id").alias(new))
    roots = components(e.join(of("file", "a", "src"), ["file", "a"]).join(of("next", "b", "dst"), ["next", "b"]).select("src", "dst"))
    rooted = ids.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    return rooted.join(labels.numbered(rooted, ["root"], "global_label"), "root").select("file", F.col("a").alias("label"), "global_label")
