"""Exact duplicates over an extendible-hash index on shared files.

A text's 64-bit hash is its key. The directory starts with buckets of about the right size; while one holds more bytes
than its capacity, the directory doubles: that bucket is split by the next bit and others keep their depth. Every
bucket is a range of keys with one owner task, which sorts its rows by key. Rows of equal keys form a chain along
which whole texts are compared, so keys that collide never join different texts. The index (directory,
buckets, overflow) is written to shared files and read back as the result.

A key whose rows alone overfill a bucket can't be split by bits. Its texts are reduced to one row in each task before
they are shuffled, and its rows find their group by a lookup. Broadcast are the directory and these keys: a bucket is
split only if it has over ``1 / BUCKETS`` of all bytes, and a key is overfull only if it has more than that or more than
``1 / HEAVY`` of all rows, so there are at most ``BUCKETS + HEAVY`` such keys and as many splits of each depth,
whatever the input. Only DataFrame functions are used.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftframe.llm.text import shared_folder, stored

#: A bucket may hold this share of all bytes, if that is more than MIN_BYTES.
BUCKETS = 1 << 16
MIN_BYTES = 1 << 19
#: A key with more than this share of all rows is overfull.
HEAVY = 1 << 10
KEY_BITS = 64


def _slot(key: Column, depth: int) -> Column:
    """The first ``depth`` bits of a key."""
    return F.shiftrightunsigned(key, KEY_BITS - depth) if depth else F.lit(0).cast("long")


def keyed(docs: DataFrame, bits: int = KEY_BITS) -> DataFrame:
    """``doc_id, text, key, row``; a null text counts as empty. Keys keep their first ``bits`` only."""
    text, row = F.coalesce(F.col("text").cast("string"), F.lit("")), F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), row.alias("row"))
    mask = -1 << (KEY_BITS - bits) if bits else 0
    return own.withColumn("key", F.xxhash64("text").bitwiseAND(F.lit(mask).cast("long")))


def directory(keys: DataFrame, capacity: int) -> DataFrame:
    """``depth, slot`` of every bucket for ``key, bytes``: none holds more than ``capacity`` but with one key alone."""
    total = keys.agg(F.sum("bytes")).first()[0] or 0
    depth, live, out = max(0, int(math.log2(max(total / capacity, 1)))), keys.select("key", "bytes"), None
    while True:
        sums = live.groupBy(_slot(F.col("key"), depth).alias("slot")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"))
        slots = stored(sums.select("slot", ((F.col("bytes") > capacity) & (F.col("n") > 1)).alias("over")))
        fits = slots.where("not over").select(F.lit(depth).alias("depth"), "slot")
        out = fits if out is None else out.unionByName(fits)
        over = slots.where("over").select("slot")
        if over.isEmpty():
            return out
        live = live.withColumn("slot", _slot(F.col("key"), depth)).join(F.broadcast(over), "slot", "left_semi").drop("slot")
        depth += 1


def owned(rows: DataFrame, buckets: DataFrame) -> DataFrame:
    """``rows`` with the ``bucket`` (its first key) that their key falls in."""
    depths = [r["depth"] for r in buckets.select("depth").distinct().orderBy("depth").collect()] or [0]  # 65 at most
    first = lambda slot, d: F.shiftleft(slot, KEY_BITS - d) if d else F.lit(0).cast("long")
    found = []
    for d in depths[:-1]:
        known = buckets.where(F.col("depth") == d).select(F.col("slot").alias(f"_{d}"))
        rows = rows.join(F.broadcast(known), _slot(F.col("key"), d) == F.col(f"_{d}"), "left")
        found.append(first(F.col(f"_{d}"), d))
    at = F.coalesce(*found, first(_slot(F.col("key"), depths[-1]), depths[-1]))
    return rows.withColumn("bucket", at).drop(*(f"_{d}" for d in depths[:-1]))


def _chains(rows: DataFrame, carry: bool) -> DataFrame:
    """Owner tasks: each bucket's rows sorted by key and compared by their bytes along the chains."""
    same = Window.partitionBy("bucket", "key", "text").orderBy(F.desc_nulls_last("doc_id"))
    whole = same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    chain = Window.partitionBy("bucket", "key").orderBy("text")
    return (
        rows.repartition("bucket")
        .withColumns({"keep_id": F.max("doc_id").over(whole), "group_size": F.count(F.lit(1)).over(whole), "kept": F.row_number().over(same) == 1, "chain": F.dense_rank().over(chain)})
        .select("bucket", "key", "chain", "doc_id", "keep_id", "group_size", "kept", F.sha2("text", 256).alias("text_sha256"), *(["row"] if carry else []))
    )


def _overflow(rows: DataFrame, carry: bool) -> DataFrame:
    """Rows of overfull keys. A key with one text needs no second comparison, others are joined by their texts."""
    texts = stored(rows.groupBy("key", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    sizes = texts.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    ranked = texts.join(F.broadcast(sizes), "key").withColumn("chain", F.dense_rank().over(Window.partitionBy("key").orderBy("text")))
    single = F.broadcast(ranked.where("n = 1").select("key", "chain", "keep_id", "group_size"))
    chained = ranked.where("n > 1").select("key", "text", "chain", "keep_id", "group_size")
    several = F.broadcast(sizes.where("n > 1").select("key"))
    found = rows.join(single, "key").unionByName(rows.join(several, "key", "left_semi").join(chained, ["key", "text"]))
    found = stored(found.select(F.col("key").alias("bucket"), "key", "chain", "doc_id", "keep_id", "group_size", F.sha2("text", 256).alias("text_sha256"), *(["row"] if carry else [])))
    top = F.col("doc_id").eqNullSafe(F.col("keep_id"))  # more than one row only where rows are repeated
    first = F.row_number().over(Window.partitionBy("key", "chain").orderBy("doc_id")) == 1
    return found.where(top).withColumn("kept", first).unionByName(found.where(~top).withColumn("kept", F.lit(False)))


def build(docs: DataFrame, path: str, carry: bool = False, bits: int = KEY_BITS, buckets: int = BUCKETS, min_bytes: int = MIN_BYTES, heavy: int = HEAVY) -> None:
    """Write the index of ``docs`` under ``path``: ``directory`` (depth, slot), ``buckets`` and ``overflow`` (one entry for
    each row: bucket, key, place in its chain, doc_id, keep_id, group_size, kept, text_sha256, and with ``carry`` the row)."""
    rows = keyed(docs, bits)
    rows = rows if carry else rows.drop("row")
    keys = stored(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text").cast("long") + 1).alias("bytes")))
    total = keys.agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).first()
    capacity = max(min_bytes, (total["bytes"] or 0) // buckets)
    overfull = (F.col("n") > 1) & ((F.col("bytes") > capacity) | (F.col("n") * heavy > (total["n"] or 0)))
    hot = F.broadcast(keys.where(overfull).select("key"))
    where = stored(directory(keys.where(~overfull), capacity))
    where.write.parquet(f"{path}/directory")
    _chains(owned(rows.join(hot, "key", "left_anti"), where), carry).write.parquet(f"{path}/buckets")
    _overflow(rows.join(hot, "key", "left_semi"), carry).write.parquet(f"{path}/overflow")


def entries(spark: SparkSession, path: str) -> DataFrame:
    """All entries of an index."""
    return spark.read.parquet(f"{path}/buckets").unionByName(spark.read.parquet(f"{path}/overflow"))


def _built(docs: DataFrame, **options: int | bool) -> DataFrame:
    path = f"{shared_folder(docs.sparkSession)}/{uuid.uuid4().hex}"
    build(docs, path, **options)
    return entries(docs.sparkSession, path)


def groups(docs: DataFrame, **options: int) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row of ``docs`` (``doc_id, text``).

    Texts are equal when all their bytes are; a null text equals the empty one. The row with the largest doc_id of
    a group stays, null ids coming last; of rows that repeat that id one stays. Other columns are not read.
    An empty table gives an empty result.
    """
    return _built(docs, **options).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def keep(docs: DataFrame, **options: int) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    return _built(docs, carry=True, **options).where("kept").select("row.*")


def sql() -> str:
    """DuckDB SQL of ``groups`` over ``documents``."""
    return """with d as (select doc_id, coalesce(text, '') as text from documents)
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size, sha256(text) as text_sha256,
  row_number() over (partition by text order by doc_id desc nulls last) = 1 as kept from d window g as (partition by text)"""
