"""Linking of files as they arrive: a persisted table of labels and roots that grows by one file at a time.

What a file adds is worked out from its own pixels, those of the file before it and the labels of both; the labels of
older files are not read. A root that a new file joins to a smaller one isn't replaced in the tables written before:
the move is written down and looked up when labels are read. A root moves once at most, so moves are a forest
and one closure over them gives the final roots.

Tables under ``path``, a folder that all executors see, each in one part for each file: ``pixels`` (t, y, x, label),
``labels`` (label, id, root), ``moves`` (node, root) and ``files`` (file, start, top). The last is written last: a file
counts once it is there, and a file whose work was interrupted is written anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from driftframe.operators import labels
from driftframe.operators.linking import components, edges_between
from driftframe.operators.stencil import KEY

SCHEMAS = {
    "pixels": "t int, y int, x int, label long",
    "labels": "label long, id long, root long",
    "moves": "node long, root long",
    "files": "file string, start long, top long",
}


def merge_labels(own: DataFrame, other: DataFrame, join: str = "start") -> DataFrame:
    """``own`` (``t, y, x, label``) with its zeros filled from ``other`` on the common steps but for the first and the last.

    ``join`` tells where ``other`` meets ``own``: the file before it at its ``start``, the one after it at its ``end``. Stubs
    are left out: labels that ``other`` has in its outermost common step, where its objects are cut off, and ``own``
    has nowhere on common steps.
    """
    if join not in ("start", "end"):
        raise ValueError("join is 'start' or 'end'")
    steps = own.select("t").distinct().join(other.select("t").distinct(), "t", "left_semi")
    span = steps.agg(F.min("t").alias("lo"), F.max("t").alias("hi"))  # one row
    there = other.where(F.col("label") != 0).join(F.broadcast(span), F.col("t").between(F.col("lo"), F.col("hi")))
    outer = there.where(F.col("t") == F.col("hi" if join == "start" else "lo")).select("label").distinct()
    held = own.where(F.col("label") != 0).join(F.broadcast(span), F.col("t").between(F.col("lo"), F.col("hi"))).join(steps, "t", "left_semi").select("label").distinct()
    stubs = outer.join(held, "label", "left_anti")
    fill = there.where((F.col("t") > F.col("lo")) & (F.col("t") < F.col("hi"))).join(steps, "t", "left_semi").join(stubs, "label", "left_anti")
    fill = fill.select(*KEY, F.col("label").alias("_other"))
    return own.join(fill, KEY, "left").select(*KEY, F.coalesce(F.nullif("label", F.lit(0)), "_other", F.lit(0)).alias("label"))


class LinkTable:
    """Global labels of a sequence of files. ``atol`` and ``rtol`` are the overlap that links need, as for
    ``linking.edges_between``; files are linked to the one before, in the order in which they are added."""

    def __init__(self, spark: SparkSession, path: str, atol: int = 5, rtol: float = 0.5):
        self.spark, self.path, self.atol, self.rtol = spark, path, atol, rtol

    def _part(self, table: str, seq: int) -> str:
        return f"{self.path}/{table}/seq={seq}"

    def _write(self, table: str, seq: int, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(self._part(table, seq))

    def _read(self, table: str, seq: int) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[table]).parquet(self._part(table, seq))

    def _all(self, table: str) -> DataFrame:
        """A table over all files that are there, with ``seq``. Parts of files that were interrupted don't count."""
        whole = self.spark.read.schema(f"{SCHEMAS[table]}, seq int").parquet(f"{self.path}/{table}")
        return whole if table == "files" else whole.join(self._all("files").select("seq"), "seq", "left_semi")

    def _exists(self, path: str) -> bool:
        context = self.spark.sparkContext
        p = context._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(context._jsc.hadoopConfiguration()).exists(p)

    def last(self) -> Row | None:
        """The file that was added last: ``file, start, top, seq``."""
        if not self._exists(f"{self.path}/files"):
            return None
        return self._all("files").orderBy(F.desc("seq")).first()

    def add(self, file: str, pixels: DataFrame) -> None:
        """Take the next file (``t, y, x, label``) in and link it to the one before it (``process_next_file`` and
        ``link_next_file`` in one). Labels of a file are whole numbers from 1 on; they need not be contiguous."""
        before = self.last()
        seq, start = (0, 0) if before is None else (before["seq"] + 1, before["start"] + before["top"])
        own = pixels.select(*(F.col(c).cast("int").alias(c) for c in KEY), F.coalesce(F.col("label").cast("long"), F.lit(0)).alias("label"))
        self._write("pixels", seq, own)
        own = self._read("pixels", seq)
        ids = own.where(F.col("label") != 0).select("label").distinct().withColumn("id", F.col("label") + start)
        if before is None:
            found = self.spark.createDataFrame([], SCHEMAS["moves"])
        else:
            edges = edges_between(self._read("pixels", before["seq"]), own, self.atol, self.rtol)
            known = self._read("labels", before["seq"]).select(F.col("label").alias("a"), F.col("root").alias("src"))
            found = components(edges.join(known, "a").select("src", (F.col("b") + start).alias("dst")))
        of = found.select(F.col("node").alias("id"), "root")
        self._write("labels", seq, ids.join(of, "id", "left").select("label", "id", F.coalesce("root", "id").alias("root")))
        self._write("moves", seq, found.where((F.col("node") <= start) & (F.col("node") != F.col("root"))))
        top = self._read("labels", seq).agg(F.coalesce(F.max("label"), F.lit(0)).alias("top"))
        self._write("files", seq, top.select(F.lit(file).cast("string").alias("file"), F.lit(start).cast("long").alias("start"), "top"))

    def label_map(self) -> DataFrame:
        """``file, label, root, global_label`` of all files so far, as ``linking.link_map`` gives for all at once."""
        final = components(self._all("moves").select(F.col("node").alias("src"), F.col("root").alias("dst")))
        known = self._all("labels").join(final.select(F.col("node").alias("root"), F.col("root").alias("final")), "root", "left")
        rooted = known.select("seq", "label", F.coalesce("final", "root").alias("root"))
        named = rooted.join(labels.numbered(rooted, ["root"], "global_label"), "root").join(self._all("files").select("seq", "file"), "seq")
        return named.select("file", "seq", "label", "root", "global_label")

    def output(self, file: str, by: str = "global_label") -> DataFrame:
        """Pixels of a file with its labels as far as they are known, and zeros filled from the files before and after.
        ``by`` is ``global_label``, or ``root``, which only changes if a later file joins objects."""
        return self._merged(self.label_map(), file, by)

    def _merged(self, known: DataFrame, file: str, by: str) -> DataFrame:
        seqs = {r["seq"] for r in self._all("files").select("seq", "file").where(F.col("file") == file).collect()}
        if len(seqs) != 1:
            raise KeyError(f"{file} was added {len(seqs)} times")
        (seq,), last = seqs, self.last()["seq"]

        def named(k: int) -> DataFrame:
            of = known.where(F.col("seq") == k).select("label", F.col(by).cast("long").alias("_new"))
            return self._read("pixels", k).join(of, "label", "left").select(*KEY, F.coalesce("_new", F.lit(0)).alias("label"))

        out = named(seq)
        if seq > 0:
            out = merge_labels(out, named(seq - 1), "start")
        return merge_labels(out, named(seq + 1), "end") if seq < last else out

    def outputs(self, by: str = "global_label") -> DataFrame:
        """The output of every file, with ``file``."""
        from driftframe.sources.store import stored

        known, out = stored(self.label_map()), None
        for r in self._all("files").select("seq", "file").orderBy("seq").collect():
            one = self._merged(known, r["file"], by).withColumn("file", F.lit(r["file"]))
            out = one if out is None else out.unionByName(one)
        return out
