"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations only.

Slots 1, 2, ... are points frac(i * golden ratio) on the unit interval; the sources' shares of the mix cut
that interval, and a slot belongs to the source whose piece its point falls into. Any stretch of the
schedule then follows the shares to within a few slots. A source's documents, in a shuffled order, are one
stream of tokens, cut into blocks of equal length; the r-th slot of a source takes its block r modulo the
number of blocks, so a source that is too small for its target is gone through again, three times at most.

Scale: texts are reduced to word counts in the scan. Running sums over a source go through buckets of its
shuffle key (sums per bucket, then inside the bucket), and ranks of slots through chunks of the schedule, so
a source with a third of all rows is spread over all tasks. Tables of one row for each source, for each
source and bucket, and for each source and chunk, are all that is ordered in full; the number of slots and
chunks is a constant, whatever the size of the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftframe.llm.text import cut, n_words, stored

#: Fractional part of the golden ratio.
GOLDEN = 0.6180339887498949
#: Resolution of the schedule: the mix is cut into about so many slots of equal length.
SLOTS = 1 << 20
#: A source is gone through so many times at most.
MAX_EPOCHS = 3
#: Slots of one chunk of the schedule, and cells of the interval in which slots and pieces meet.
CHUNK, CELLS = 1 << 14, 1 << 12


def source_order(source: Column) -> list[Column]:
    """By code point, null last (Spark compares strings by UTF-8 bytes, which is the same order)."""
    return [source.isNull(), source]


def targets(sizes: DataFrame, cycle: int = 3, epochs: int = MAX_EPOCHS) -> DataFrame:
    """``source, source_size`` with ``target``: words shared by weights 1..cycle in source order.

    A target stops at ``epochs`` times its source's size and the excess is shared again by weight. That
    comes to ``min(epochs * size, level * weight)`` with one level for all: in order of cap / weight, a
    prefix is at its cap, and the level follows from what the prefix leaves.
    """
    w = Window.orderBy(*source_order(F.col("source")))
    t = sizes.withColumn("weight", (F.row_number().over(w) - 1) % cycle + 1).withColumn("cap", epochs * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), *source_order(F.col("source")))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    t = t.withColumn("left", F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    t = t.withColumn("level", F.col("left") / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.row_number().over(order).alias("at"), F.col("level")))
    t = t.withColumn("fits", fits)
    first = F.min("fits").over(whole)["level"]
    return t.withColumn("target", F.least(F.col("cap").cast("double"), F.col("weight") * F.coalesce(first, F.lit(0.0)))).select("source", "source_size", "target")


def shuffle_key(doc_id: Column, size: Column) -> Column:
    return F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), size.cast("string")))


def streams(rows: DataFrame) -> DataFrame:
    """``doc_id, source, size`` with ``start``: the words before the document in its source's shuffled stream."""
    rows = rows.withColumn("key", shuffle_key(F.col("doc_id"), F.col("size"))).withColumn("bucket", F.substring("key", 1, 3))
    w = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = rows.groupBy("source", "bucket").agg(F.sum("size").alias("s")).withColumn("before", F.coalesce(F.sum("s").over(w), F.lit(0)))
    own = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn("inside", F.coalesce(F.sum("size").over(own), F.lit(0)))
    b = buckets.select(F.col("source").alias("b_source"), F.col("bucket").alias("b_bucket"), "before")
    joined = inside.join(b, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bucket") == F.col("b_bucket")))
    return joined.withColumn("start", F.col("before") + F.col("inside")).select("doc_id", "source", "size", "start")


def schedule(shares: DataFrame) -> DataFrame:
    """``source, rank`` of every slot. ``shares``: ``source, lower, upper`` in slots, pieces of [0, total)."""
    spark = shares.sparkSession
    n = shares.agg(F.max("upper")).first()[0] or 0.0
    i = F.col("id")
    point = i * F.lit(GOLDEN) - F.floor(i * F.lit(GOLDEN))
    slots = spark.range(1, int(n + 0.5) + 1).withColumn("point", point * F.lit(float(n)))
    cell = lambda c: F.floor(F.col(c) * F.lit(CELLS / (float(n) or 1.0))).cast("int")
    pieces = shares.where("lower < upper").withColumn("cell", F.explode(F.sequence(cell("lower"), cell("upper"))))
    placed = slots.withColumn("cell", cell("point")).join(pieces, "cell").where("point >= lower and point < upper")
    placed = placed.select("source", "id", F.floor(i / CHUNK).alias("chunk"))
    w = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = placed.groupBy("source", "chunk").count().withColumn("before", F.coalesce(F.sum("count").over(w), F.lit(0)))
    c = chunks.select(F.col("source").alias("c_source"), F.col("chunk").alias("c_chunk"), "before")
    ranked = placed.withColumn("inside", F.row_number().over(Window.partitionBy("source", "chunk").orderBy("id")) - 1)
    joined = ranked.join(c, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("chunk") == F.col("c_chunk")))
    return joined.select("source", (F.col("before") + F.col("inside")).alias("rank"))


def mix(docs: DataFrame, cycle: int = 3, epochs: int = MAX_EPOCHS, slots: int = SLOTS) -> DataFrame:
    """``doc_id, size, source, source_size, target, taken`` for every row of ``docs`` (``doc_id, text, source``).

    ``size`` is the number of words, ``taken`` how many of them the mix takes, repeats counted. A null or
    blank text has size 0 and is not taken; null is a source of its own, the last. Repeated rows are further
    documents. Equal inputs give equal results whatever the partitioning: rows are ordered by a hash of
    ``doc_id`` and size, and rows that tie are equal. An empty table gives an empty result.
    """
    rows = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text").cast("string")).alias("size")))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    t = targets(sizes, cycle, epochs)
    # blocks of a source: n_blocks of them, of size / n_blocks words, cut at floor(b * size / n_blocks)
    total = F.sum("source_size").over(Window.partitionBy())
    block = F.greatest(F.ceil(total / F.lit(slots)), F.lit(1))
    t = t.withColumn("n_blocks", F.ceil(F.col("source_size") / block)).withColumn("slots", F.coalesce(F.col("target") * F.col("n_blocks") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0)))
    w = Window.orderBy(*source_order(F.col("source")))
    t = stored(t.withColumn("upper", F.sum("slots").over(w)).withColumn("lower", F.coalesce(F.lag("upper").over(w), F.lit(0.0))))
    blocks = t.select(F.col("source").alias("t_source"), "source_size", "target", "n_blocks")
    ranks = schedule(t.select("source", "lower", "upper"))
    same = F.col("source").eqNullSafe(F.col("t_source"))
    taken = (
        ranks.join(blocks, same)
        .where(F.col("rank") < epochs * F.col("n_blocks"))
        .groupBy(F.col("source").alias("k_source"), (F.col("rank") % F.col("n_blocks")).alias("k_block"))
        .agg(F.count(F.lit(1)).alias("times"))
    )
    s, size, n, a = F.col("source_size"), F.col("size"), F.col("n_blocks"), F.col("start")
    spans = streams(rows.where(F.col("size") > 0)).join(blocks, same)
    # block b holds the words from floor(b * s / n): word a is in block ceil((a + 1) * n / s) - 1
    of = lambda word: F.floor(((word + 1) * n - 1) / s)
    cut_at = lambda b: F.floor(b * s / n)
    parts = spans.withColumn("block", F.explode(F.sequence(of(a), of(a + size - 1))))
    parts = parts.withColumn("words", F.least(a + size, cut_at(F.col("block") + 1)) - F.greatest(a, cut_at(F.col("block"))))
    got = parts.join(taken, F.col("source").eqNullSafe(F.col("k_source")) & (F.col("block") == F.col("k_block")), "left")
    full = got.groupBy("source", "start", "doc_id", "size", "source_size", "target").agg(F.sum(F.col("words") * F.coalesce(F.col("times"), F.lit(0))).alias("taken"))
    none = rows.where(F.col("size") == 0).join(blocks, same).withColumn("taken", F.lit(0).cast("long"))
    columns = ["doc_id", "size", "source", "source_size", "target", "taken"]
    return full.select(*columns).unionByName(none.select(*columns))


def repeated(docs: DataFrame, cycle: int = 3, epochs: int = MAX_EPOCHS, slots: int = SLOTS) -> DataFrame:
    """The mix itself, in whole documents: each row of ``docs`` as often as ``taken`` / ``size`` rounds to (half
    up), all columns. Rows of size 0 go. Rows that agree in doc_id, source and size share what they are taken
    together, evenly and rounded as one.
    """
    found = mix(docs, cycle, epochs, slots).groupBy("doc_id", "source", "size").agg(F.sum("taken").alias("t"), F.count(F.lit(1)).alias("n"))
    times = F.floor(F.col("t") / (F.col("n") * F.col("size")) + 0.5).cast("int")
    plan = found.where(F.col("size") > 0).select(F.col("doc_id").alias("p_id"), F.col("source").alias("p_source"), F.col("size").alias("p_size"), times.alias("times")).where("times > 0")
    own = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("id"),
        F.col("source").cast("string").alias("of"), n_words(F.col("text").cast("string")).alias("words"),
    )
    joined = own.join(plan, F.col("id").eqNullSafe(F.col("p_id")) & F.col("of").eqNullSafe(F.col("p_source")) & (F.col("words") == F.col("p_size")))
    return joined.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def sql(cycle: int = 3, epochs: int = MAX_EPOCHS, slots: int = SLOTS) -> str:
    """The same in DuckDB SQL, over ``documents``; without buckets and chunks, which don't show in the result."""
    return rf"""
with recursive d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, (row_number() over (order by source is null, source) - 1) % {cycle} + 1 as weight, {epochs} * source_size as cap from s),
o as (select *, row_number() over (order by cap / weight, source is null, source) as pos from w),
l as (select *, ((sum(source_size) over () - coalesce(sum(cap) over (order by pos rows between unbounded preceding and 1 preceding), 0))::double
   / (sum(weight) over () - coalesce(sum(weight) over (order by pos rows between unbounded preceding and 1 preceding), 0))::double) as level from o),
v as (select arg_min(level, pos) as level from l where level * weight <= cap),
t as (select source, source_size, least(cap::double, weight * coalesce(v.level, 0)) as target,
   greatest(ceil(sum(source_size) over () / {slots}.0), 1)::bigint as block from l cross join v),
n as (select *, ceil(source_size / block::double)::bigint as n_blocks from t),
q as (select *, coalesce(target * n_blocks / nullif(source_size, 0), 0) as slots from n),
u as (select *, sum(slots) over (order by source is null, source rows unbounded preceding) as upper from q),
c as (select *, coalesce(lag(upper) over (order by source is null, source), 0) as lower, max(upper) over () as top from u),
i as (select i, (i * {GOLDEN!r}::double - floor(i * {GOLDEN!r}::double)) * (select any_value(top) from c) as point from range(1, (select floor(any_value(top) + 0.5)::bigint + 1 from c)) r(i)),
r as (select source, n_blocks, row_number() over (partition by source order by i) - 1 as rank from i join c on point >= lower and point < upper),
k as (select source, rank % n_blocks as block, count(*) as times from r where rank < {epochs} * n_blocks group by all),
a as (select doc_id, source, size, row_number() over () as id, coalesce(sum(size) over (partition by source order by md5(coalesce(doc_id::varchar, '') || ':' || size::varchar), doc_id nulls first, size
   rows between unbounded preceding and 1 preceding), 0)::bigint as start from d where size > 0),
p as (select id, a.doc_id, a.source, a.size, start, source_size, target, n_blocks,
   unnest(range(((start + 1) * n_blocks - 1) // source_size, ((start + size) * n_blocks - 1) // source_size + 1)) as block from a join c on a.source is not distinct from c.source),
f as (select p.*, least(start + size, (p.block + 1) * source_size // n_blocks) - greatest(start, p.block * source_size // n_blocks) as words, coalesce(times, 0) as times
   from p left join k on p.source is not distinct from k.source and p.block = k.block)
select doc_id, size, source_size, target, sum(words * times)::bigint as taken from f group by id, doc_id, size, source_size, target
union all select doc_id, size, source_size, target, 0 from d join c on d.source is not distinct from c.source where size = 0"""
