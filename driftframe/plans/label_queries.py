"""Label algebra, linking across files and graph closure."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftframe.functions import stats
from driftframe.operators import incremental, labels, linking
from driftframe.plans import fixtures as fx
from driftframe.plans.registry import query
from driftframe.sources.store import shared_folder


def _label(spark: SparkSession, sf_dir: str, shift: int = 0) -> DataFrame:
    return fx.label(spark, sf_dir, shift)


SLICED = fx.LABEL + ", s as (select t, y, x, v, label, case when label = 0 then 0 else r end::int as step_label from (select *, dense_rank() over (order by label = 0, t, label) as r from label))"


@query(f"with {SLICED} select t, y, x, label, step_label from s")
def slice_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.slice_labels(_label(spark, sf_dir)).select("t", "y", "x", "label", "step_label")


@query(f"with {fx.LABEL} select t, y, x, case when label = 0 then 0 else dense_rank() over (order by label = 0, label * 7 % 13, label) end::int as label from label where label not in (3, 5)")
def relabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers with gaps, shuffled, made contiguous again."""
    p = _label(spark, sf_dir).where("label not in (3, 5)").withColumn("label", F.when(F.col("label") != 0, F.col("label") * 7 % 13 * 100 + F.col("label")).otherwise(0))
    return labels.relabel(p).select("t", "y", "x", "label")


@query(f"with {fx.LABEL} select t, y, x, case when label % 2 = 1 then label * 10 else 0 end::int as label from label")
def remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _label(spark, sf_dir)
    m = p.select("label").distinct().where("label % 2 = 1").withColumn("new_label", F.col("label") * 10)
    return labels.remap(p, m).select("t", "y", "x", "label")


FILTERED = "k as (select label, dense_rank() over (order by label)::int as n from c where {cond}) select t, y, x, coalesce(n, 0)::int as label from label l left join k using (label)"


@query(f"with {fx.LABEL}, g as (select * replace (case when label = 0 then 0 else (t // label)::bigint * 32 + label end as label) from label), label_ as (select * from g), c as (select label, max(t) - min(t) + 1 as len from g where label <> 0 group by label), k as (select label, dense_rank() over (order by label)::int as n from c where len >= 5) select t, y, x, coalesce(n, 0)::int as label from g left join k using (label)")
def filter_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels cut in time into pieces of as many steps as their number; those of five or more stay."""
    p = _label(spark, sf_dir)
    cut = F.when(F.col("label") == 0, 0).otherwise(F.floor(F.col("t") / F.col("label")) * 32 + F.col("label"))
    return labels.filter_labels(p.withColumn("label", cut), 5).select("t", "y", "x", "label")


@query(f"with {fx.LABEL}, c as (select label, bool_or(v > 0.4) as a, bool_or(v between 0.3 and 0.301) as b from label where label <> 0 group by label), {FILTERED.format(cond='a and b')}")
def filter_by_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.filter_labels(_label(spark, sf_dir), 0, [F.col("v") > 0.4, F.col("v").between(0.3, 0.301)]).select("t", "y", "x", "label")


@query(f"with {fx.LABEL} select label, max(t) - min(t) + 1 as length, bool_or(v > 0.42) as inside from label where label <> 0 group by label")
def label_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _label(spark, sf_dir)
    return labels.lengths(p).join(labels.mask_labels(p, F.col("v") > 0.42), "label")


@query(f"with {SLICED} select label, list(distinct step_label order by step_label) as steps from s where label <> 0 group by label")
def steps_of_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.steps_of(labels.slice_labels(_label(spark, sf_dir)))


@query(f"""with {fx.LABELS2}, s as (select t, y, x, dense_rank() over (order by t, label) as step_label from label where label <> 0),
c as (select step_label, b.label as parent, count(*) as n from s join label2 b using (t, y, x) where b.label <> 0 group by all)
select step_label::int as step_label, arg_min(parent, {{'n': -n, 'p': parent}}) as parent from c group by step_label""")
def step_to_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = labels.slice_labels(_label(spark, sf_dir)).select("t", "y", "x", "step_label")
    return labels.step_parents(p.join(_label(spark, sf_dir, 3).select("t", "y", "x", "label"), ["t", "y", "x"]))


@query(f"with {fx.LABELS2}, c as (select a.t, b.label, count(*) as n from label a join label2 b using (t, y, x) where a.label <> 0 and b.label <> 0 group by all) select t, arg_min(label, {{'n': -n, 'l': label}}) as mode from c group by t")
def overlap_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _label(spark, sf_dir).where("label <> 0").select("t", "y", "x")
    return a.join(_label(spark, sf_dir, 3), ["t", "y", "x"]).groupBy("t").agg(stats.overlap_mode(F.col("label")).alias("mode"))


PAIRS = """a as (select t, y, x, label as a from label where label <> 0), b as (select t, y, x, label as b from label2 where label <> 0),
na as (select a, count(*) as n_a from a group by a), nb as (select b, count(*) as n_b from b group by b), c as (select a, b, count(*) as n from a join b using (t, y, x) group by all)"""


@query(f"with {fx.LABELS2}, {PAIRS} select a, b, n, n_a, n_b from c join na using (a) join nb using (b) where n > 40 and n >= 0.2 * least(n_a, n_b)")
def overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.overlaps(_label(spark, sf_dir), _label(spark, sf_dir, 3), 0.2, 40)


@query(f"with {fx.LABELS2}, {PAIRS} select a, case when max(n) >= 5 then arg_min(b, {{'n': -n, 'b': b}}) else 0 end as b from c group by a")
def max_overlap_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.max_overlap(_label(spark, sf_dir), _label(spark, sf_dir, 3))


@query(f"""with {fx.LABELS2}, {PAIRS}, i as (select a, case when max(n) >= 5 then arg_min(b, {{'n': -n, 'b': b}}) else 0 end as b from c group by a)
select q.t, q.y, q.x, coalesce(nullif(i.b, 0), q.label)::int as label from label2 q left join label p using (t, y, x) left join i on p.label = i.a""")
def link_cores_and_anvils(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The anvil cube with the pixels of linked cores."""
    return labels.link_cores_and_anvils(_label(spark, sf_dir), _label(spark, sf_dir, 3))[1].select("t", "y", "x", "label")


@query(f"with {fx.LABELS2} select a.t, a.y, a.x, case when a.t % 2 = 0 and a.label <> 0 then a.label else b.label end::int as label from label a join label2 b using (t, y, x)")
def fill_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _label(spark, sf_dir).withColumn("label", F.when(F.col("t") % 2 == 0, F.col("label")).otherwise(0))
    return labels.fill_from(own, _label(spark, sf_dir, 3)).select("t", "y", "x", "label")


CROSS = fx.LABELS2 + """, w as (select min(t) + 1 as lo, max(t) - 1 as hi from label), a as (select t, y, x, (t // 9)::bigint * 32 + label as a from label, w where label <> 0 and t between lo and hi),
b as (select t, y, x, (t // 7)::bigint * 32 + label as b from label2, w where label <> 0 and t between lo and hi), na as (select a, count(*) as n_a from a group by a), nb as (select b, count(*) as n_b from b group by b),
c as (select a, b, count(*) as n from a join b using (t, y, x) group by all), e as (select a, b, n, n_a, n_b from c join na using (a) join nb using (b) where n >= 5 and n >= 0.5 * least(n_a, n_b))"""


def _files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    def cut(df: DataFrame, k: int) -> DataFrame:
        return df.withColumn("label", F.when(F.col("label") == 0, 0).otherwise(F.floor(F.col("t") / k) * 32 + F.col("label")))

    return cut(_label(spark, sf_dir), 9), cut(_label(spark, sf_dir, 3), 7)


@query(f"with {CROSS} select * from e")
def cross_file_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.edges_between(*_files(spark, sf_dir))


@query(f"""with recursive {CROSS}, u as (select a as p, 1099511627776 + b as q from e union all select 1099511627776 + b, a from e), r as (select p as node, p as root from u union select u.q, r.root from r join u on u.p = r.node)
select node, min(root) as root from r group by node""")
def cross_file_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = linking.edges_between(*_files(spark, sf_dir)).select(F.col("a").alias("src"), (F.col("b") + 2**40).cast("long").alias("dst"))
    return linking.components(e)


#: Six files over all steps, each with the first five steps of the next one; labels are those of two cubes by turns, cut
#: after every few steps. Links of each file with the next one, and their closure.
ARRIVING = fx.LABELS2 + """, n as (select (max(t) // 6 + 1)::bigint as k from label),
c as (select *, unnest([t // k, t // k - 1]) as f from (select label.*, label2.label as other, k from label join label2 using (t, y, x), n)),
p as (select f, t, y, x, case when f % 2 = 0 then label else other end as own, case when f % 2 = 0 then 9 else 7 end as cut from c where f >= 0 and t < (f + 1) * k + 5),
px as (select f, t, y, x, case when own = 0 then 0 else ((t - f * (select k from n)) // cut) * 32 + own end as label from p),
spans as (select a.f, min(a.t) as lo, max(a.t) as hi from px a join px b on b.f = a.f + 1 and b.t = a.t and b.y = a.y and b.x = a.x group by a.f),
pa as (select px.* from px join spans using (f) where label <> 0 and t > lo and t < hi), pb as (select px.f - 1 as f, t, y, x, label from px join spans on spans.f = px.f - 1 where label <> 0 and t > lo and t < hi),
na as (select f, label as a, count(*) as na from pa group by all), nb as (select f, label as b, count(*) as nb from pb group by all),
met as (select pa.f, pa.label as a, pb.label as b, count(*) as n from pa join pb using (f, t, y, x) group by all),
e as (select f, f * 4294967296 + a as p, (f + 1) * 4294967296 + b as q from met join na using (f, a) join nb using (f, b) where n >= 5 and n >= 0.5 * least(na, nb)),
u as (select p, q from e union select q, p from e), ids as (select distinct f, label, f * 4294967296 + label as id from px where label <> 0),
r as (select id as node, id as root from ids union select u.q, r.root from r join u on u.p = r.node), roots as (select node, min(root) as root from r group by node),
map as (select f, label, dense_rank() over (order by root) as global_label from ids join roots on node = id)"""


def arriving(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The files of ``ARRIVING``, as ``t, y, x, label``."""
    both = _label(spark, sf_dir).select("t", "y", "x", "label").join(_label(spark, sf_dir, 3).select("t", "y", "x", F.col("label").alias("other")), ["t", "y", "x"])
    k = both.agg(F.floor(F.max("t") / 6).alias("k")).first()["k"] + 1

    def file(f: int) -> DataFrame:
        own, cut = ("label", 9) if f % 2 == 0 else ("other", 7)
        here = both.where((F.col("t") >= f * k) & (F.col("t") < (f + 1) * k + 5))
        return here.select("t", "y", "x", F.when(F.col(own) == 0, 0).otherwise(F.floor((F.col("t") - f * k) / cut) * 32 + F.col(own)).alias("label"))

    return [file(f) for f in range(6)]


def _arriving(spark: SparkSession, sf_dir: str) -> incremental.LinkTable:
    """The files, added one by one."""
    table = incremental.LinkTable(spark, f"{shared_folder(spark)}/{uuid.uuid4().hex}")
    for f, pixels in enumerate(arriving(spark, sf_dir)):
        table.add(str(f), pixels)
    return table


@query(f"with recursive {ARRIVING} select f::varchar as file, label::bigint as label, global_label::int as global_label from map")
def incremental_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Global labels of files that are added one by one."""
    return _arriving(spark, sf_dir).label_map().select("file", "label", "global_label")


@query(f"""with recursive {ARRIVING}, g as (select px.f, t, y, x, coalesce(global_label, 0) as label from px left join map using (f, label)),
pre as (select g.f + 1 as f, t, y, x, label, lo, hi from g join spans using (f) where t between lo and hi and label <> 0), has_pre as (select distinct g.f, label from g join spans on spans.f = g.f - 1 where t between lo and hi),
fill_pre as (select f, t, y, x, label as pl from pre where t > lo and t < hi and (f, label) not in (select f, label from pre where t = hi and (f, label) not in (select f, label from has_pre))),
g1 as (select f, t, y, x, coalesce(nullif(label, 0), pl, 0) as label from g left join fill_pre using (f, t, y, x)),
nxt as (select g.f - 1 as f, t, y, x, label, lo, hi from g join spans on spans.f = g.f - 1 where t between lo and hi and label <> 0), has_nxt as (select distinct g1.f, label from g1 join spans using (f) where t between lo and hi),
fill_nxt as (select f, t, y, x, label as nl from nxt where t > lo and t < hi and (f, label) not in (select f, label from nxt where t = lo and (f, label) not in (select f, label from has_nxt)))
select f::varchar as file, t, y, x, coalesce(nullif(label, 0), nl, 0)::bigint as label from g1 left join fill_nxt using (f, t, y, x)""")
def linked_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of files added one by one with their global labels, gaps filled from their neighbours without stubs."""
    return _arriving(spark, sf_dir).outputs()


@query("""with f as (select date_trunc('month', ts)::date as file, max(user_id) as m from events group by 1)
select file, coalesce(sum(m) over (order by file rows between unbounded preceding and 1 preceding), 0)::bigint as start, lag(file) over (order by file) as previous, lead(file) over (order by file) as next from f""")
def file_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each file's labels start in the global numbering, and its neighbours."""
    e = fx.table(spark, sf_dir, "events")
    return linking.offsets(e.groupBy(F.trunc("ts", "month").alias("file")).agg(F.max("user_id").alias("max_label")))


@query(f"with {fx.LABEL}, k as (select distinct label from label where label <> 0) select label, case when label % 3 = 0 then label * 10 else 100 + row_number() over (partition by label % 3 = 0 order by label) end as global_label from k")
def carry_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of a new file: linked ones keep their number, others count on."""
    known = _label(spark, sf_dir).where("label <> 0").select("label").distinct()
    c = F.col("label")
    return linking.carry_over(known, F.when(c % 3 == 0, c * 10), 100).select("label", F.col("global_label").cast("long").alias("global_label"))


@query(f"""with {fx.LABEL}, c as (select *, unnest([t // 6, t // 6 - 1]) as f from label), p as (select f, t, y, x, case when (t + f) % 3 = 0 or label = 0 then 0 else f::bigint * 32 + label end as label from c where f >= 0 and t <= 6 * f + 10),
s as (select f, min(t) as lo, max(t) as hi from p group by f), i as (select p.* from p join s using (f) where t > lo and t < hi)
select p.f::bigint as file, p.t, p.y, p.x, coalesce(nullif(p.label, 0), nullif(a.label, 0), nullif(b.label, 0), 0) as label from p left join i a on a.f = p.f - 1 and a.t = p.t and a.y = p.y and a.x = p.x left join i b on b.f = p.f + 1 and b.t = p.t and b.y = p.y and b.x = p.x""")
def merge_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps of files filled from the files before and after; a file begins every six steps and has eleven."""
    c, first = F.col, F.floor(F.col("t") / 6)
    p = _label(spark, sf_dir).withColumn("file", F.explode(F.array(first, first - 1))).where("file >= 0 and t <= 6 * file + 10")
    own = F.when(((c("t") + c("file")) % 3 == 0) | (c("label") == 0), 0).otherwise(c("file") * 32 + c("label"))
    return linking.merge_neighbours(p.select("file", "t", "y", "x", own.alias("label")))


@query(f"""with recursive {fx.LABELS2}, n as (select a.label as a, b.label as b, count(*) as n from label a join label2 b using (t, y, x) where a.label <> 0 and b.label <> 0 group by all), e as (select 'a' || lpad(a::varchar, 12, '0') as p, 'b' || lpad(b::varchar, 12, '0') as q from n where n > 300),
u as (select p, q from e union select q, p from e), r as (select p as node, p as root from u union select u.q, r.root from r join u on u.p = r.node)
select left(node, 1) as side, substr(node, 2)::bigint as label, min(root) as root from r group by node""")
def bipartite_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of two cubes closed over their overlaps."""
    return linking.bipartite_closure(_label(spark, sf_dir), _label(spark, sf_dir, 3), 0.0, 300)


@query(f"""with {fx.LABEL} select label, t, round(arg_min(v, y * 64 + x), 6) as first, round(arg_max(v, y * 64 + x), 6) as last, arg_max((y * 64 + x)::bigint, v) as place from label where label <> 0 group by label, t""")
def label_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several results for each label from its values and their places together."""

    def ends(part) -> dict[str, object]:
        top = part.loc[part["v"].idxmax()]
        return {"first": round(float(part["v"].iloc[0]), 6), "last": round(float(part["v"].iloc[-1]), 6), "place": int(top["y"] * 64 + top["x"])}

    return labels.apply_with_positions(_label(spark, sf_dir).where("label <> 0"), ["label", "t"], ends, "first double, last double, place long")
