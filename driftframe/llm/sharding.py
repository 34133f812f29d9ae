"""Shards by vector bin packing: bytes, tokens and rows are balanced jointly.

Equal texts form a group. Groups are hashed into a fixed number of cells, so that what is packed has a
bound that doesn't depend on the input; a group that is large against a shard gets cells of its own, into
which its rows are dealt. The cells' vectors (bytes, tokens, rows) go to the driver, which places each
cell, largest first, where the dot product of its vector with the shard's residual capacity is highest.

At most ``cells + spread * shards`` vectors reach the driver and come back as a broadcast: with the default
parameters under 10,000 rows of five numbers. Texts are read once and never shuffled. Slots come from the counts of
the cells placed before in the same shard, the counts of the stretches before in the same cell and the rank inside
the stretch, so no task holds a whole shard, nor a large cell.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftframe.llm.text import cut, n_words

#: Cells that ordinary groups are hashed into.
CELLS = 8192
#: A group over 1 / SPREAD of a shard's bytes, tokens or rows is dealt out over cells of at most that size.
SPREAD = 4
#: A cell of over so many times the mean number of rows is ranked in stretches of about that size.
STRETCH = 4


def pack(vectors: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each vector. Components count as shares of one shard's capacity; a full shard's
    residual is negative, which keeps the order of shards right when sizes don't fit evenly."""
    v = np.asarray(vectors, dtype=float)
    total = v.sum(axis=0)
    need = v / np.where(total > 0, total / shards, 1.0)
    left = np.ones((shards, v.shape[1]))
    out = np.zeros(len(v), dtype=np.int64)
    for i in np.lexsort((np.arange(len(v)), -need.max(axis=1, initial=0))):
        out[i] = best = int(np.argmax(left @ need[i]))
        left[best] -= need[i]
    return out


def assign(docs: DataFrame, shards: int = 8, cells: int = CELLS, spread: int = SPREAD) -> DataFrame:
    """``doc_id, size, tokens, text_crc32, shard, slot`` for every row of ``docs`` (``doc_id, text``).

    ``size`` is the UTF-8 length plus 1; a null text is a group of its own, apart from the empty text.
    Equal texts share a shard unless their group is dealt out. Repeated rows, equal and null ids each keep
    their row; rows that are equal in all outputs but the slot may swap slots. An empty table gives none.
    """
    text = F.col("text").cast("string")
    rows = cut(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        n_words(text).alias("tokens"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.when(text.isNull(), F.lit(0)).otherwise(F.xxhash64(text)).alias("group"),
    )).withColumn("row", F.monotonically_increasing_id())  # of stored rows, so it doesn't change
    sums = [F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")]
    groups = rows.groupBy("group").agg(*sums)
    total = groups.agg(F.sum("b").alias("b"), F.sum("t").alias("t"), F.sum("n").alias("n")).first()
    share = [max(1.0, (total[k] or 0) / (shards * spread)) for k in "btn"]
    # of groups over a share there are at most shards * spread in each component
    large = {
        r["group"]: int(r["parts"])
        for r in groups.withColumn("parts", F.ceil(F.greatest(F.col("b") / share[0], F.col("t") / share[1], F.col("n") / share[2]))).where(F.col("parts") > 1).select("group", "parts").collect()
    }
    spark = docs.sparkSession
    first, start = {}, cells
    for g in sorted(large):
        first[g] = start
        start += large[g]
    hot = F.broadcast(spark.createDataFrame([(g, first[g], large[g]) for g in sorted(large)], "`group` long, first long, parts long"))
    cell = F.when(F.col("first").isNull(), F.pmod(F.col("group"), F.lit(cells))).otherwise(F.col("first") + F.pmod(F.xxhash64("doc_id", "row"), F.col("parts")))
    dealt = rows.join(hot, "group", "left").withColumn("cell", cell.cast("long")).drop("group", "first", "parts")
    found = dealt.groupBy("cell").agg(*sums).collect()
    found.sort(key=lambda r: r["cell"])
    where = pack(np.array([[r["b"], r["t"], r["n"]] for r in found]).reshape(-1, 3), shards)
    filled, plan = [0] * shards, []
    for r, s in zip(found, where.tolist(), strict=True):
        plan.append((r["cell"], s, filled[s], -(-r["n"] * len(found) // (STRETCH * total["n"]))))
        filled[s] += r["n"]
    placed = dealt.join(F.broadcast(spark.createDataFrame(plan, "cell long, shard int, before long, stretches long")), "cell")
    placed = placed.withColumn("stretch", F.pmod(F.xxhash64("doc_id", "row"), F.col("stretches")))
    # at most a row of three numbers for each cell and a quarter as many more
    sums = placed.groupBy("cell", "stretch").count()
    sooner = Window.partitionBy("cell").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = F.broadcast(sums.select("cell", "stretch", F.coalesce(F.sum("count").over(sooner), F.lit(0)).alias("start")))
    rank = F.row_number().over(Window.partitionBy("cell", "stretch").orderBy("doc_id", "row"))
    return placed.join(starts, ["cell", "stretch"]).withColumn("slot", F.col("before") + F.col("start") + rank - 1).select("doc_id", "size", "tokens", "text_crc32", "shard", "slot")


def write(docs: DataFrame, path: str, shards: int = 8, **options: int) -> None:
    """Write ``doc_id, text`` with its shard as folders ``shard=<n>`` under ``path``, each row once."""
    keys = ["doc_id", "text_crc32", "size"]
    copy = F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0))).alias("copy")  # equal rows may be in different shards
    placed = assign(docs, shards, **options).select(*keys, "shard", copy)
    text = F.col("text").cast("string")
    keyed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
    ).select(*keys, "text", copy)
    same = [keyed[c].eqNullSafe(placed[c]) for c in [*keys, "copy"]]
    keyed.join(placed, same[0] & same[1] & same[2] & same[3]).select(keyed["doc_id"], keyed["text"], placed["shard"]).write.partitionBy("shard").parquet(path)
