"""Archives read by member, with filters in planning, and the table function over lists of labels."""

import datetime
import gzip
import io
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from driftframe.functions import emit
from driftframe.sources import archives


def packed(spark, folder, kind="zip"):
    rows = [(f"day{d}.{kind}", f"radar_202401{d:02d}{h:02d}0000.txt{'.gz' if h % 2 else ''}", f"{d}-{h} é".encode()) for d in (1, 2, 3) for h in (0, 5, 11)]
    made = archives.pack(spark.createDataFrame(rows, "archive string, member string, content binary"), str(folder), kind)
    assert {(r["archive"], r["members"]) for r in made.collect()} == {(f"day{d}.{kind}", 3) for d in (1, 2, 3)}
    return rows


@pytest.mark.parametrize("kind", ["zip", "tar"])
def test_members_come_back(spark, tmp_path, kind):
    if kind == "zip":  # members of a zip file are written as they are, so what is to be unpacked has to be packed before
        rows = [(a, m.removesuffix(".gz"), c) for a, m, c in packed(spark, tmp_path / "other", "tar")]
        archives.pack(spark.createDataFrame(rows, "archive string, member string, content binary"), str(tmp_path / "in"), "zip").collect()
    else:
        rows = packed(spark, tmp_path / "in", kind)
    got = archives.read(spark, str(tmp_path / "in"))
    assert got.rdd.getNumPartitions() == 9
    assert {(r["archive"], r["member"], bytes(r["content"])) for r in got.collect()} == set(rows)
    assert {r["time"] for r in got.collect()} == {datetime.datetime(2024, 1, d, h) for d in (1, 2, 3) for h in (0, 5, 11)}


def test_a_filter_skips_members_in_planning(spark, tmp_path):
    packed(spark, tmp_path, "tar")
    whole = archives.read(spark, str(tmp_path))
    late = whole.where(F.col("time") >= F.lit(datetime.datetime(2024, 1, 2, 5)))
    assert late.rdd.getNumPartitions() == 5 and late.count() == 5
    one = whole.where((F.col("archive") == "day2.tar") & (F.col("time") < F.lit(datetime.datetime(2024, 1, 2, 11))))
    assert one.rdd.getNumPartitions() == 2 and one.count() == 2
    assert whole.where(F.length("content") > 6).count() == 3  # not known before members are read
    assert whole.where(F.col("time") > F.lit(datetime.datetime(2030, 1, 1))).count() == 0
    assert archives.read(spark, str(tmp_path), glob="day3*").count() == 3


def test_corrupt_archives_and_names_without_times(spark, tmp_path):
    packed(spark, tmp_path, "tar")
    (tmp_path / "bad.tar").write_bytes(b"no archive")
    with zipfile.ZipFile(tmp_path / "more.zip", "w") as z:
        z.writestr("notes.txt", "x")
        z.writestr("99999999999999.txt", "")
        z.writestr("folder/", "")
    with pytest.raises(Exception, match="(?i)read"):
        archives.read(spark, str(tmp_path)).count()
    got = archives.read(spark, str(tmp_path), corrupt="skip")
    assert got.count() == 11 and got.where("time is null").count() == 2
    with pytest.raises(Exception, match="corrupt"):
        archives.read(spark, str(tmp_path), corrupt="maybe").count()


def test_tar_of_packed_members(tmp_path):
    with tarfile.open(tmp_path / "a.tar", "w") as t:
        data = gzip.compress(b"gate")
        info = tarfile.TarInfo("KTLX20240101_000000_V06.gz")
        info.size = len(data)
        t.addfile(info, io.BytesIO(data))
    with open(tmp_path / "a.tar", "rb") as f:
        assert list(archives.members(f)) == [(info.name, len(data))] and archives.member(f, info.name) == b"gate"
    assert archives.member_time(info.name) == datetime.datetime(2024, 1, 1)


def test_lists_of_labels_of_any_table(spark):
    emit.register(spark)
    spark.createDataFrame([(1, 2, [7, 8]), (1, 1, [7, 7]), (2, 1, [8]), (2, 2, None), (2, 3, [])], "core int, t int, labels array<int>").createOrReplaceTempView("steps_of")
    got = spark.sql("select * from emit_labels(table(select * from steps_of) partition by core order by t)")
    assert [f.simpleString() for f in got.schema] == ["core:int", "t:int", "position:int", "label:int", "first:boolean"]
    assert sorted(map(tuple, got.collect())) == [(1, 1, 0, 7, True), (1, 1, 1, 7, False), (1, 2, 0, 7, False), (1, 2, 1, 8, True), (2, 1, 0, 8, True)]
    spark.createDataFrame([("x", ["a", None, "a"])], "name string, seen array<string>").createOrReplaceTempView("names_of")
    other = spark.sql("select * from emit_labels(table(select * from names_of) partition by name)")
    assert [f.simpleString() for f in other.schema][2:] == ["label:string", "first:boolean"]
    assert sorted(map(tuple, other.collect())) == [("x", 0, "a", True), ("x", 1, None, True), ("x", 2, "a", False)]
    for bad in ("select 1 as a", "select 1 as label, array(1) as l"):
        with pytest.raises(Exception, match="list|given by"):
            spark.sql(f"select * from emit_labels(table({bad}))").collect()
