"""Streams of linking: files padded by neighbours, and labels carried by overlap with state kept between batches."""

import datetime
import random

import pytest
from pyspark.sql import functions as F
from test_linking import files_of

from driftframe.operators import linking
from driftframe.streaming import links, sessions

T0 = datetime.datetime(2024, 1, 1)


def write(spark, rows, folder, batches):
    """Rows as one Parquet file for each batch, in order."""
    for k in range(max(batches) + 1):
        own = [(*r, T0 + datetime.timedelta(minutes=10 * r[1])) for r, b in zip(rows, batches, strict=True) if b == k]
        spark.createDataFrame(own, "file long, t int, y int, x int, label int, ts timestamp").coalesce(1).write.mode("append").parquet(folder)


def counts_of(spark, folder, base, **options):
    stream = spark.readStream.schema("file long, t int, y int, x int, label int, ts timestamp").option("maxFilesPerTrigger", 1).parquet(folder)
    with sessions.keyed_state(spark):
        return sessions.drained(spark, links.overlap_counts(stream, tile=5, **options), checkpoint=base)


def named(df):
    return {(r["file"], r["label"], r["global_label"]) for r in df.collect()}


@pytest.mark.parametrize("split", [False, True])
def test_a_stream_in_batches_gives_the_links_of_the_batch(spark, tmp_path, split):
    rows, rnd = files_of(random.Random(2)), random.Random(3)
    batches = [2 * r[0] + (rnd.random() < 0.5) if split else r[0] for r in rows]  # a file in one batch or dealt over two
    write(spark, rows, str(tmp_path / "in"), batches)
    counts = counts_of(spark, str(tmp_path / "in"), str(tmp_path / "base"))
    want = named(linking.link_map(spark.createDataFrame(rows, "file long, t int, y int, x int, label int")))
    assert named(links.links(counts)) == want and counts.where("kind = 'late'").isEmpty()
    sizes = counts.where("kind = 'size'").agg(F.sum("n")).first()[0]
    assert sizes == len(rows)


def test_rows_of_older_files_are_counted_and_not_linked(spark, tmp_path):
    rows = files_of(random.Random(2), n_files=3)
    late = [r[0] == 0 and r[2] == 0 for r in rows]
    write(spark, rows, str(tmp_path / "in"), [3 if x else r[0] for r, x in zip(rows, late, strict=True)])
    counts = counts_of(spark, str(tmp_path / "in"), str(tmp_path / "base"))
    assert counts.where("kind = 'late'").agg(F.sum("n")).first()[0] == sum(late)
    rest = [r for r, x in zip(rows, late, strict=True) if not x]
    assert named(links.links(counts)) == named(linking.link_map(spark.createDataFrame(rest, "file long, t int, y int, x int, label int")))


def test_a_small_grid_over_many_steps_is_many_states(spark, tmp_path):
    """One tile holds the grid: its steps are dealt out by blocks, and labels still meet those of the file before."""
    rows = [(f, t, y, x, 1 + t // 50) for f in (0, 1) for t in range(60 * f, 60 * f + 70) for y in range(3) for x in range(3)]
    write(spark, rows, str(tmp_path / "in"), [r[0] for r in rows])
    counts = counts_of(spark, str(tmp_path / "in"), str(tmp_path / "base"))
    assert named(links.links(counts)) == named(linking.link_map(spark.createDataFrame(rows, "file long, t int, y int, x int, label int")))
    states = spark.read.format("statestore").option("stateVarName", "files").load(str(tmp_path / "base" / "state"))
    assert states.count() == 5  # of 130 steps


def test_a_timer_drops_the_state(spark, tmp_path):
    """The third file comes a week after the second, as the first does again: nothing is left to meet."""
    box = [(t, y, x, 1) for t in range(6) for y in range(4) for x in range(4)]
    near = [(0, *p) for p in box] + [(1, *p) for p in box]
    week = 6 * 24 * 7
    far = [(2, t + week, y + 50, x, 1) for t, y, x, _ in box] + [(3, t + week, y + 50, x, 1) for t, y, x, _ in box] + [(4, *p) for p in box]
    write(spark, [*near, *far], str(tmp_path / "in"), [r[0] for r in [*near, *far]])
    kept = counts_of(spark, str(tmp_path / "in"), str(tmp_path / "kept"))
    dropped = counts_of(spark, str(tmp_path / "in"), str(tmp_path / "dropped"), late="8 days", forget_seconds=3600.0)
    pairs = lambda df: {(r["file"], r["next"]) for r in df.where("kind = 'pair'").collect()}
    assert pairs(kept) == {(0, 1), (2, 3), (1, 4)} and (0, 1) in pairs(dropped)
    gone = counts_of(spark, str(tmp_path / "in"), str(tmp_path / "gone"), late="1 hour", forget_seconds=3600.0)
    assert pairs(gone) == {(0, 1), (2, 3)}  # rows of the first place are behind the watermark by then


def test_padding_from_two_streams_is_that_of_tables(spark, tmp_path):
    rnd = random.Random(9)
    files = [(f, T0 + datetime.timedelta(hours=6 * f), T0 + datetime.timedelta(hours=6 * f + 6)) for f in range(8)]
    steps = [(i, T0 + datetime.timedelta(minutes=rnd.randint(-600, 3600))) for i in range(400)] + [(-1, T0), (-2, T0 + datetime.timedelta(hours=7.5))]
    want = {(f, i, a <= t < b) for f, a, b in files for i, t in steps if a - datetime.timedelta(hours=1.5) <= t < b + datetime.timedelta(hours=1.5)}
    for k in range(4):  # batches by turns
        spark.createDataFrame(files[k::4], "file long, start timestamp, end timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "files"))
        spark.createDataFrame(steps[k::4], "id long, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "steps"))
    read = lambda name, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    out = sessions.drained(spark, links.padded(read("files", "file long, start timestamp, end timestamp"), read("steps", "id long, ts timestamp"), 5400.0, "4 days"))
    got = [(r["file"], r["id"], r["inside"]) for r in out.collect()]
    assert set(got) == want and len(got) == len(want)
    tables = links.padded(spark.createDataFrame(files, "file long, start timestamp, end timestamp"), spark.createDataFrame(steps, "id long, ts timestamp"), 5400.0, "4 days")
    assert {(r["file"], r["id"], r["inside"]) for r in tables.collect()} == want
