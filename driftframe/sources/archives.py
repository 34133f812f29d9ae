"""Archives as a source: the members of zip and tar files as rows, one partition for each member.

    spark.dataSource.register(ArchiveSource)
    spark.read.format("archive").option("path", folder).load()       # archive, member, time, size, content

Planning reads the lists of members, not the members. Comparisons of ``time``, which a member's name tells, and equal names of
archives are pushed down to it, so members that a filter leaves out are neither opened nor scheduled. (The session's
``spark.sql.python.filterPushdown.enabled`` turns that on; without it the same rows are filtered later.) Members that end in
``.gz`` are unpacked. Spark keeps one plan of members for each table that is loaded, so a query that filters the same archives in
two ways loads them twice, each with its own filter. Files are opened through Arrow's file systems, on local and shared folders and in object stores.
"""

from __future__ import annotations

import fnmatch
import gzip
import io
import operator
import re
import tarfile
import zipfile
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

SCHEMA = "archive string, member string, time timestamp, size long, content binary"

#: Digits of a time in a member's name, and what they mean.
TIMES = ((r"(\d{14})", "%Y%m%d%H%M%S"), (r"(\d{8}_\d{6})", "%Y%m%d_%H%M%S"), (r"(\d{12})", "%Y%m%d%H%M"))

COMPARISONS: dict[type, Callable] = {
    ds.EqualTo: operator.eq, ds.GreaterThan: operator.gt, ds.GreaterThanOrEqual: operator.ge, ds.LessThan: operator.lt, ds.LessThanOrEqual: operator.le,
}


def member_time(name: str) -> datetime | None:
    """The first time that a name holds, None without one."""
    for pattern, form in TIMES:
        for digits in re.findall(pattern, name):
            try:
                return datetime.strptime(digits, form)
            except ValueError:
                continue
    return None


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if re.match(r"[a-z0-9]+:", uri):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))
    return fs.LocalFileSystem(), uri


def _zipped(data: io.BufferedIOBase) -> bool:
    """By the first bytes; the rest is left to be read from the beginning."""
    data.seek(0)
    start = data.read(4)
    data.seek(0)
    return start in (b"PK\x03\x04", b"PK\x05\x06")


def members(data: io.BufferedIOBase) -> Iterator[tuple[str, int]]:
    """``name, size`` of the files in an archive, in its order."""
    if _zipped(data):
        with zipfile.ZipFile(data) as z:
            yield from ((i.filename, i.file_size) for i in z.infolist() if not i.is_dir())
    else:
        with tarfile.open(fileobj=data) as t:
            yield from ((i.name, i.size) for i in t if i.isfile())


def member(data: io.BufferedIOBase, name: str) -> bytes:
    if _zipped(data):
        with zipfile.ZipFile(data) as z:
            raw = z.read(name)
    else:
        with tarfile.open(fileobj=data) as t:
            raw = t.extractfile(name).read()
    return gzip.decompress(raw) if name.endswith(".gz") else raw


@dataclass
class Member(ds.InputPartition):
    archive: str
    name: str
    time: datetime | None
    size: int

    def __post_init__(self) -> None:
        super().__init__(self.name)


class ArchiveReader(ds.DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.glob = options["path"], options.get("glob", "*")
        self.corrupt = options.get("corrupt", "fail")
        if self.corrupt not in ("fail", "skip"):
            raise ValueError("corrupt is 'fail' or 'skip'")
        self.tests: list[tuple[str, Callable, object]] = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        """What is known of a member before it is read is tested in planning; other filters are given back."""
        for f in filters:
            compare, column = COMPARISONS.get(type(f)), getattr(f, "attribute", ())
            if compare and column in (("time",), ("archive",), ("member",)):
                self.tests.append((column[0], compare, f.value))
            elif isinstance(f, ds.IsNotNull) and column in (("time",), ("archive",), ("member",)):
                self.tests.append((column[0], lambda value, _: value is not None, None))
            else:
                yield f

    def _wanted(self, known: dict[str, object]) -> bool:
        for column, compare, value in self.tests:
            own = known[column]
            if isinstance(value, datetime) and value.tzinfo is not None:
                value = value.astimezone().replace(tzinfo=None)
            if own is None or not compare(own, value):
                return False
        return True

    def partitions(self) -> list[Member]:
        files, path = opened(self.path)
        found = files.get_file_info(fs.FileSelector(path, recursive=True))
        out = []
        for info in sorted((i for i in found if i.is_file and fnmatch.fnmatch(i.base_name, self.glob)), key=lambda i: i.path):
            try:
                with files.open_input_file(info.path) as f:
                    listed = list(members(io.BufferedReader(f)))
            except (tarfile.TarError, zipfile.BadZipFile, EOFError):
                if self.corrupt == "fail":
                    raise
                continue
            for name, size in listed:
                known = {"archive": info.base_name, "member": name, "time": member_time(name)}
                if self._wanted(known):
                    out.append(Member(info.path, name, known["time"], size))
        return out or [Member("", "", None, 0)]  # without partitions Spark has nothing to run

    def read(self, partition: Member) -> Iterator[tuple]:
        if not partition.archive:
            return
        files, _ = opened(self.path)
        with files.open_input_file(partition.archive) as f:
            content = member(io.BufferedReader(f), partition.name)
        yield partition.archive.rsplit("/", 1)[-1], partition.name, partition.time, partition.size, content


class ArchiveSource(ds.DataSource):
    """Options: ``path``, a folder that is searched with those below it; ``glob``, names of archives; ``corrupt``, whether
    an archive that can't be listed is an error (``fail``) or left out (``skip``)."""

    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> ArchiveReader:
        return ArchiveReader(dict(self.options))


def read(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The members of the archives under ``path``."""
    spark.dataSource.register(ArchiveSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("archive").options(path=path, **options).load()


def pack(rows: DataFrame, path: str, kind: str = "zip") -> DataFrame:
    """Write ``archive, member, content`` as one file for each archive under ``path`` and return ``archive, members``. An archive is
    made by one task; a file appears under its name only when it is whole, so a task that is run again replaces it."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        files, folder = opened(path)
        files.create_dir(folder, recursive=True)
        name, buffer = part["archive"].iloc[0], io.BytesIO()
        part = part.sort_values("member")
        if kind == "zip":
            with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
                for m, content in zip(part["member"], part["content"], strict=True):
                    z.writestr(m, content)
        else:
            with tarfile.open(fileobj=buffer, mode="w") as t:
                for m, content in zip(part["member"], part["content"], strict=True):
                    data = gzip.compress(content, 1) if m.endswith(".gz") else content
                    info = tarfile.TarInfo(m)
                    info.size = len(data)
                    t.addfile(info, io.BytesIO(data))
        with files.open_output_stream(f"{folder}/.{name}.part") as out:
            out.write(buffer.getvalue())
        files.move(f"{folder}/.{name}.part", f"{folder}/{name}")
        return pd.DataFrame({"archive": [name], "members": [len(part)]})

    own = rows.select("archive", "member", F.col("content").cast("binary").alias("content"))
    return own.groupBy("archive").applyInPandas(run, "archive string, members long")
