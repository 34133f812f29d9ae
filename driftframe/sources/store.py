"""Tables that a job keeps between its steps, in the shared folder that the session names.

What is kept can be read again by any executor, so a lost one costs a step at most and lineage stays short.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of files beyond which a kept table is not sent whole to all executors. Files of pixels and labels hold a row in a byte
#: or two, of which 40 or more are made when it is read, so their size, by which Spark decides, says nothing about a broadcast.
BROADCAST_BYTES = 1 << 17


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``. Only in one JVM (``local``, as in tests) is a
    temporary one made where nothing is set; on a cluster no executor would see it, so that is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if context.master.split("[")[0] != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            named = tempfile.mkdtemp(prefix="checkpoints")
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` worked out once and kept as a checkpoint."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` worked out once and kept as a compressed table. Joins with a large one, and with what is made of its rows,
    shuffle both sides; a side named ``broadcast`` still is one."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    return kept.hint("merge") if _bytes(df.sparkSession, path) > BROADCAST_BYTES else kept


def _bytes(spark: SparkSession, path: str) -> int:
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(context._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


def forget(*tables: DataFrame) -> None:
    """Remove the files of tables that ``stored`` has made and that are read no more."""
    for df in tables:
        context = df.sparkSession.sparkContext
        for name in df.inputFiles()[:1]:
            path = context._jvm.org.apache.hadoop.fs.Path(name).getParent()
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
