"""Linking of labels across files: overlaps on shared steps, global numbers, and the closure of links.

Files are rows of one table (``file``), not a loop: offsets are a running sum over files, overlaps one join of
each file with the next, and one closure over all links gives the global labels.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftframe.operators import kernels, labels
from driftframe.operators.stencil import KEY
from driftframe.sources.store import forget, stored

#: Links that begin among so many consecutive numbers (a power of 2) are joined by one task before the rounds of a closure.
BUCKET_BITS = 14
#: Links of a bucket that one task joins.
GROUP_LINKS = 1 << 17


def edges_between(current: DataFrame, following: DataFrame, atol: int = 5, rtol: float = 0.5, trim: bool = True) -> DataFrame:
    """Links of labels of two files over their common steps without the first and the last: at least ``atol``
    shared pixels and ``rtol`` of the smaller label there. Fewer than three common steps give none."""
    common = current.select("t").distinct().join(following.select("t").distinct(), "t", "left_semi")
    if trim:
        span = common.agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
        common = common.join(F.broadcast(span), (F.col("t") > F.col("lo")) & (F.col("t") < F.col("hi"))).select("t")
    inside = lambda df: df.join(F.broadcast(common), "t", "left_semi")
    return labels.overlaps(inside(current), inside(following), rtol, atol, strict=False)


def offsets(files: DataFrame) -> DataFrame:
    """``file, start, previous, next`` for ``file, max_label``: the number of labels in the files before."""
    w = Window.orderBy("file")
    before = F.sum("max_label").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return files.select("file", F.coalesce(before, F.lit(0)).alias("start"), F.lag("file").over(w).alias("previous"), F.lead("file").over(w).alias("next"))


def contracted(edges: DataFrame) -> DataFrame:
    """Links with the same nodes and components as ``src, dst`` (whole numbers). Where both ends lie in one bucket, each
    node is linked only to the smallest one that the links of its group lead to: labels are numbered by step, so most of a
    chain over time lies in one bucket. Links to other buckets stay as they are, so a node with many has no group of them;
    a bucket with over ``GROUP_LINKS`` links is dealt out by the larger end, which leaves the components the same."""
    kind = "bigint" if "bigint" in dict(edges.dtypes).values() else "int"

    def run(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(("src", "dst"), kernels.stars(part["src"].to_numpy(), part["dst"].to_numpy()), strict=True)))

    ends = edges.select(F.least("src", "dst").cast(kind).alias("src"), F.greatest("src", "dst").cast(kind).alias("dst"))
    near, far = dealt(ends)
    return near.groupBy("bucket", "part").applyInPandas(run, f"src {kind}, dst {kind}").unionByName(far)


def dealt(ends: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links ``src, dst`` (the smaller end first) within one bucket, with the ``bucket`` and the ``part`` of it that one task
    takes, and the links between buckets."""
    bucket = F.shiftright("src", BUCKET_BITS)
    ends = ends.withColumn("bucket", F.when(bucket == F.shiftright("dst", BUCKET_BITS), bucket))
    near, far = ends.where("bucket is not null"), ends.where("bucket is null").select("src", "dst")
    parts = near.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / GROUP_LINKS).alias("parts")).where("parts > 1")
    part = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.hash("dst"), F.col("parts")))
    return near.join(parts, "bucket", "left").withColumn("part", part).drop("parts"), far


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of undirected ``src, dst``: the smallest node that can be reached. Each round takes the
    smallest root among neighbours, then the root's root; the number of rounds is logarithmic on chains of buckets, or
    of nodes that are no whole numbers. Tables of rounds that are over are removed."""
    edges = edges.select("src", "dst")
    if set(dict(edges.dtypes).values()) <= {"int", "bigint"}:
        given = stored(edges)  # counted, then contracted
        edges = contracted(given)
    else:
        given = None
    both = stored(edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    if given is not None:
        forget(given)
    roots = _lowest(both, stored(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("m")).select("node", F.least("node", "m").alias("root"))))
    forget(both)
    return roots


def _lowest(links: DataFrame, roots: DataFrame) -> DataFrame:
    """``node, root`` when every node has taken the smallest root among those that ``links`` (``src, dst``) let it take
    from, ``dst`` from ``src``, and then that root's own, until nothing changes. Tables of rounds that are over are removed."""
    step = roots
    while True:
        near = links.join(roots.select(F.col("node").alias("src"), F.col("root").alias("near")), "src").groupBy(F.col("dst").alias("node")).agg(F.min("near").alias("near"))
        new = roots.join(near, "node", "left").select("node", F.col("root").alias("old"), F.least("root", "near").alias("new"))
        new = stored(new.join(roots.select(F.col("node").alias("new"), F.col("root").alias("top")), "new").select("node", "old", F.least("new", "top").alias("root")))
        forget(step)
        step, roots = new, new.select("node", "root")
        if step.where("old <> root").isEmpty():
            return roots


def ancestors(edges: DataFrame) -> DataFrame:
    """``node, root`` of directed ``src, dst`` (whole numbers): the smallest node that leads to each one along links, or itself.

    If objects are discovered from the lowest label that has none, each taking what its links lead to, a label goes to just
    that node: nothing smaller leads to it, so it begins an object, and what lies between can't have been taken before.
    Nodes that link each other both ways have the same ancestors; they are joined as components first, which takes a
    logarithmic number of rounds. Between what is left, roots are handed on along links and replaced by their own roots, so
    chains of rising numbers halve in each round too; others take a round for each rise after a fall.
    """
    edges = stored(edges.select("src", "dst").where("src <> dst").distinct())
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    parts = components(edges.where("src < dst").join(back, ["src", "dst"]))
    of = lambda c: parts.select(F.col("node").alias(c), F.col("root").alias(f"part_{c}"))
    part = lambda c: F.coalesce(f"part_{c}", c).alias(c)
    between = edges.join(of("src"), "src", "left").join(of("dst"), "dst", "left").select(part("src"), part("dst")).where("src <> dst").distinct()
    between = stored(between)
    ends = between.select(F.col("src").alias("node")).union(between.select("dst")).distinct()
    roots = _lowest(between, stored(ends.select("node", F.col("node").alias("root"))))
    top = roots.select(F.col("node").alias("part_node"), "root")
    out = stored(nodes.join(of("node"), "node", "left").withColumn("part_node", part("node")).join(top, "part_node", "left").select("node", F.coalesce("root", "part_node").alias("root")))
    forget(edges, between)
    return out


def link_map(pixels: DataFrame, atol: int = 5, rtol: float = 0.5) -> DataFrame:
    """``file, label, global_label`` for pixels of many files (``file, t, y, x, label``): overlaps of each file with
    the next, closed over all files, numbered from 1 in the order of file and label."""
    own = pixels.where(F.col("label") != 0)
    files = offsets(pixels.groupBy("file").agg(F.max("label").alias("max_label")))
    ids = own.select("file", "label").distinct().join(F.broadcast(files), "file").withColumn("id", F.col("start") + F.col("label"))
    # interior common steps of each file with its next one
    steps = pixels.select("file", "t").distinct()
    after = files.where(F.col("next").isNotNull()).select("file", "next")
    common = steps.join(after, "file").join(steps.select(F.col("file").alias("next"), "t"), ["next", "t"])
    w = Window.partitionBy("file")
    common = common.withColumns({"lo": F.min("t").over(w), "hi": F.max("t").over(w)}).where((F.col("t") > F.col("lo")) & (F.col("t") < F.col("hi"))).select("file", "next", "t")
    a = own.join(common, ["file", "t"]).select("file", "next", *KEY, F.col("label").alias("a"))
    b = own.withColumnRenamed("file", "next").join(common, ["next", "t"]).select("file", "next", *KEY, F.col("label").alias("b"))
    n = a.join(b, ["file", "next", *KEY]).groupBy("file", "next", "a", "b").count()
    na, nb = a.groupBy("file", "a").agg(F.count(F.lit(1)).alias("na")), b.groupBy("file", "next", "b").agg(F.count(F.lit(1)).alias("nb"))
    e = n.join(na, ["file", "a"]).join(nb, ["file", "next", "b"]).where((F.col("count") >= max(atol, 1)) & (F.col("count") >= rtol * F.least("na", "nb")))
    of = lambda side, name: ids.select(F.col("file").alias(side), F.col("label").alias(name), F.col("id").alias(f"id_{name}"))
    edges = e.join(of("file", "a"), ["file", "a"]).join(of("next", "b"), ["next", "b"]).select(F.col("id_a").alias("src"), F.col("id_b").alias("dst"))
    roots = components(edges).withColumnRenamed("node", "id")
    rooted = ids.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    return rooted.join(labels.numbered(rooted, ["root"], "global_label"), "root").select("file", "label", "global_label")


def relabel_files(pixels: DataFrame, links: DataFrame) -> DataFrame:
    """Pixels with global labels."""
    return pixels.join(links, ["file", "label"], "left").withColumn("label", F.coalesce("global_label", F.lit(0))).drop("global_label")


def merge_neighbours(pixels: DataFrame) -> DataFrame:
    """Zeros of each file filled from its neighbours on common steps, but for the step at which the other file
    begins or ends, where its objects are cut off."""
    span = pixels.groupBy("file").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    files = offsets(span.select("file", F.lit(0).alias("max_label")))
    inner = pixels.join(F.broadcast(span), "file").where((F.col("t") > F.col("lo")) & (F.col("t") < F.col("hi"))).select("file", *KEY, F.col("label").alias("_o"))
    for side in ("previous", "next"):
        other = files.where(F.col(side).isNotNull()).select("file", F.col(side).alias("_f")).join(inner.withColumnRenamed("file", "_f"), "_f").drop("_f")
        pixels = pixels.join(other, ["file", *KEY], "left").withColumn("label", F.coalesce(F.nullif("label", F.lit(0)), "_o", F.lit(0))).drop("_o")
    return pixels


def bipartite_closure(a: DataFrame, b: DataFrame, overlap: float = 0.0, absolute: int = 0) -> DataFrame:
    """``side, label, root`` of linked labels of two cubes: closure over overlaps in both directions."""
    e = labels.overlaps(a, b, overlap, absolute)
    key = lambda side, c: F.concat(F.lit(side), F.lpad(F.col(c).cast("string"), 12, "0"))
    c = components(e.select(key("a", "a").alias("src"), key("b", "b").alias("dst")))
    return c.select(F.substring("node", 1, 1).alias("side"), F.substring("node", 2, 12).cast("long").alias("label"), "root")


def carry_over(known: DataFrame, linked: Column, previous_max: int) -> DataFrame:
    """Sequential numbering: ``label`` of a new file becomes ``linked`` where that is not null, else the next number
    after ``previous_max``, in order."""
    new = labels.numbered(known.where(linked.isNull()), ["label"], "n").select("label", (F.lit(previous_max) + F.col("n")).alias("global_label"))
    return known.where(linked.isNotNull()).select("label", linked.alias("global_label")).unionByName(new)
