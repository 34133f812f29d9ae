"""Fields from channels, gaps, calibration and composites."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftframe.functions import emit, radiance
from driftframe.plans import fixtures as fx
from driftframe.plans.registry import query
from driftframe.plans.stat_queries import r6
from driftframe.sources import archives, files, frames
from driftframe.sources.store import shared_folder

CHANNELS = fx.CUBE + """, ch as (select t, y, x, 270 + 20 * v as C13, case when (t + y + x) % 17 <> 0 then 240 + 10 * v end as C08, 245 + 5 * v as C10, 268 + 19 * v as C15, case when (y * x) % 31 = 7 then 1 else 0 end as DQF_C13 from cube)"""


def _channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    return fx.cube(spark, sf_dir).select(
        "t", "y", "x", (270 + 20 * v).alias("C13"), F.when((F.col("t") + F.col("y") + F.col("x")) % 17 != 0, 240 + 10 * v).alias("C08"), (245 + 5 * v).alias("C10"), (268 + 19 * v).alias("C15"),
        F.when(F.col("y") * F.col("x") % 31 == 7, 1).otherwise(0).alias("DQF_C13"),
    )


@query(f"""with {CHANNELS}, b as (select *, C08 is null or DQF_C13 <> 0 as bad from ch)
select t, y, x, round(case when not bad then C13 end, 6) as bt, round(case when not bad then C08 - C10 end, 6) as wvd, round(case when not bad then C13 - C15 end, 6) as swd from b""")
def load_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three fields of four channels, masked together."""
    return r6(frames.goes_fields(_channels(spark, sf_dir)))


@query(f"""with {fx.CUBE}, z as (select t, y, (v - avg(v) over g) / (stddev_pop(v) over g + 1e-8) as z from cube window g as (partition by t, x)) select t, y, round(abs(avg(z)), 6) as stripe from z group by t, y""")
def stripe_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(frames.stripe_deviation(fx.cube(spark, sf_dir), "v"))


@query(f"""with {fx.CUBE}, p as (select case when t < 7 then t * 600.0 else t * 600.0 + 3000 end::double as s, y, x, v from cube), n as (select s, lead(s) over (order by s) as n from (select distinct s from p)),
h as (select (s + n) / 2 as s from n where n - s > 900) select s, y, x, v from p union all select h.s, g.y, g.x, null from h, (select distinct y, x from p) g""")
def fill_time_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An empty step in the middle of a gap."""
    t = F.col("t") * 600.0
    p = fx.cube(spark, sf_dir).select(F.when(F.col("t") < 7, t).otherwise(t + 3000).alias("s"), "y", "x", "v")
    return frames.fill_gaps(p, p.select("s").distinct(), 900.0)


@query(f"""with {fx.CUBE} select t, y, x, v from cube where t % 5 <> 2 union all select t, y, x - 4, -v from cube where t % 5 = 2 and x >= 4""")
def splice_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing steps from another view, shifted by four columns."""
    c = fx.cube(spark, sf_dir)
    return frames.splice(c.where("t % 5 <> 2"), c.withColumn("v", -F.col("v")), dx=4, time="t").select("t", "y", "x", "v")


@query(f"""with {fx.CUBE}, b as (select t, y, x, 50 + 100 * v as rad, x % 16 as band, x % 5 - 1 as dqf from cube)
select t, y, x, round(case when dqf between 0 and 1 then case when band < 7 then rad * 0.002 else (1400.0 / ln(12000.0 / rad + 1) - 0.1) / 0.999 end end::double, 6) as value from b where rad > 0""")
def calibrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reflectance or brightness temperature by band, where the quality is good."""
    k = F.lit
    b = fx.cube(spark, sf_dir).select("t", "y", "x", (50 + 100 * F.col("v")).alias("rad"), (F.col("x") % 16).alias("band"), (F.col("x") % 5 - 1).alias("dqf")).where("rad > 0")
    return r6(b.select("t", "y", "x", radiance.calibrated(F.col("band"), F.col("rad"), k(0.002), k(12000.0), k(1400.0), k(0.1), k(0.999), F.col("dqf")).alias("value")))


F259 = 259 * (100.0 + 255) / (255 * 259 - 100.0)


@query(f"""with {fx.CUBE}, c as (select t, y, x, least(greatest(0.5 + v, 0), 1) ** 0.4 as r, least(greatest(0.5 - v, 0), 1) ** 0.4 as n, least(greatest(0.3 + v, 0), 1) ** 0.4 as b from cube),
g as (select *, least(greatest(0.48358168 * r + 0.45706946 * b + 0.06038137 * n, 0), 1) as g from c)
select t, y, x, round(least(greatest({F259!r} * (r - 0.5) + 0.5, 0), 1), 6) as r, round(least(greatest({F259!r} * (g - 0.5) + 0.5, 0), 1), 6) as g, round(least(greatest({F259!r} * (b - 0.5) + 0.5, 0), 1), 6) as b from g""")
def true_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    rgb = radiance.true_colour(0.3 + v, 0.5 + v, 0.5 - v)
    return r6(fx.cube(spark, sf_dir).select("t", "y", "x", rgb.alias("c")).select("t", "y", "x", "c.*"))


@query(f"""with {fx.CUBE}, c as (select t, y, x, v + 0.5 as c02, 250 + 40 * v as c08, 260 + 50 * v as c13, greatest(v + 0.4, 0.05) as mu from cube)
select t, y, x, round(least(greatest((c08 - c13 + 35) / 40, 0), 1), 6) as r, round(least(greatest((c02 / mu - 0.7) / 0.3, 0), 1), 6) as g, round(1 - least(greatest((c13 - 243.6) / 49, 0), 1), 6) as b from c""")
def deep_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    rgb = radiance.deep_cloud(v + 0.5, 250 + 40 * v, 260 + 50 * v, v + 0.4)
    return r6(fx.cube(spark, sf_dir).select("t", "y", "x", rgb.alias("c")).select("t", "y", "x", "c.*"))


@query("with f as (select event_id, ts from events), b as (select min(ts) + interval 10 days as lo, min(ts) + interval 20 days as hi from f) select event_id, ts from f, b where ts >= lo and ts <= hi - interval 1 second")
def trimmed_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of ten days."""
    e = fx.table(spark, sf_dir, "events").select("event_id", "ts")
    b = F.broadcast(e.agg((F.min("ts") + F.expr("interval 10 days")).alias("lo"), (F.min("ts") + F.expr("interval 20 days")).alias("hi")))
    return files.trim(e.join(b), F.col("lo"), F.col("hi"), "ts").select("event_id", "ts")


@query("""with m as (select min(ts) + interval 10 days as lo, min(ts) + interval 20 days as hi from events) select event_id, ts from events, m where ts >= lo and ts < hi
union all (select event_id, ts from events, m where ts < lo order by ts desc, event_id desc limit 12) union all (select event_id, ts from events, m where ts >= hi order by ts, event_id limit 12)""")
def padded_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with twelve steps on either side."""
    e = fx.table(spark, sf_dir, "events").select("event_id", "ts")
    lo, hi = (F.lit(e.agg(F.min("ts")).first()[0]) + F.expr(f"interval {n} days") for n in (10, 20))
    return files.padded(e, lo, hi, 12, "ts")


@query("select p_partkey as k, 'part-' || p_partkey as name, 1000 + p_size * 10 as length from part where abs(10 * p_size + 1000 - (1000 + (p_partkey % 50) * 10)) <= 1.0 + 0.1 * (1000 + (p_partkey % 50) * 10)")
def same_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files about as long as a manifest says."""
    name = F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("name")
    p = fx.table(spark, sf_dir, "part")
    manifest = p.select(name, (1000 + F.col("p_partkey") % 50 * 10).alias("size"))
    return files.same_size(p.select(F.col("p_partkey").alias("k"), name, (1000 + F.col("p_size") * 10).alias("length")), manifest).select("k", "name", "length")


@query("""with f as (select l_orderkey as k, l_linenumber as n, l_extendedprice as sw, l_extendedprice * (1 - l_discount) as swc, l_quantity * 1000 as lw, l_quantity * 990 as lwc from lineitem)
select k, n, round(sw - swc, 6) as toa_swup_cre, round(lw - lwc, 6) as toa_lwup_cre, round(-((sw - swc) + (lw - lwc)), 6) as toa_net_cre from f""")
def radiative_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = fx.table(spark, sf_dir, "lineitem")
    f = li.select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_extendedprice").alias("toa_swup"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("toa_swup_clr"),
        (F.col("l_quantity") * 1000).alias("toa_lwup"), (F.col("l_quantity") * 990).alias("toa_lwup_clr"),
    )
    return r6(radiance.add_effects(f).select("k", "n", "toa_swup_cre", "toa_lwup_cre", "toa_net_cre"))


@query("""select event_id, user_id, 'day_' || strftime(ts, '%Y%m%d') || '.tar' as archive, 'events_' || strftime(time_bucket(interval 6 hours, ts), '%Y%m%d%H%M%S') || '.csv.gz' as member from events""")
def archive_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events packed as an archive for each day with a member for six hours, and read back, early and late members each by a
    filter in planning."""
    ts = F.col("ts").cast("timestamp")
    slot = F.timestamp_seconds(F.floor(F.unix_seconds(ts) / 21600) * 21600)
    e = fx.table(spark, sf_dir, "events").withColumns({
        "archive": F.concat(F.lit("day_"), F.date_format(ts, "yyyyMMdd"), F.lit(".tar")), "member": F.concat(F.lit("events_"), F.date_format(slot, "yyyyMMddHHmmss"), F.lit(".csv.gz")),
    })
    content = F.concat_ws("\n", F.collect_list(F.concat_ws(",", "event_id", "user_id")))
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    archives.pack(e.groupBy("archive", "member").agg(content.alias("content")), folder, "tar").collect()  # a row for each day
    middle = e.agg(F.timestamp_micros(F.avg(F.unix_micros(ts)).cast("long")).alias("m")).first()["m"]
    early, late = archives.read(spark, folder).where(F.col("time") < F.lit(middle)), archives.read(spark, folder).where(F.col("time") >= F.lit(middle))
    lines = early.unionByName(late).select("archive", "member", F.explode(F.split(F.decode("content", "UTF-8"), "\n")).alias("line"))
    part = lambda i: F.split("line", ",")[i].cast("long")
    return lines.select(part(0).alias("event_id"), part(1).alias("user_id"), "archive", "member")


@query(f"""with {fx.LABEL}, a as (select y, t, list(distinct label order by label) as labels from label where label <> 0 group by y, t),
b as (select user_id, ts::date as day, list(distinct event_type order by event_type) as types from events group by 1, 2),
ea as (select y::bigint as key, t::varchar as step, unnest(labels)::varchar as label, generate_subscripts(labels, 1)::int - 1 as position from a),
eb as (select user_id as key, day::varchar as step, unnest(types) as label, generate_subscripts(types, 1)::int - 1 as position from b)
select 'a' as source, key, step, position, label, row_number() over (partition by key, label order by step::int, position) = 1 as first from ea
union all select 'b', key, step, position, label, row_number() over (partition by key, label order by step, position) = 1 from eb""")
def emit_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of labels by row and step, and of event types by user and day, as rows, from one table function."""
    emit.register(spark)
    own = fx.label(spark, sf_dir).where("label <> 0").groupBy("y", "t").agg(F.sort_array(F.collect_set("label")).alias("labels"))
    days = fx.table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sort_array(F.collect_set("event_type")).alias("types"))
    return spark.sql(
        """select 'a' as source, cast(y as bigint) as key, cast(t as string) as step, position, cast(label as string) as label, first from emit_labels(table(select * from {own}) partition by y order by t)
        union all select 'b', user_id, cast(day as string), position, label, first from emit_labels(table(select * from {days}) partition by user_id order by day)""",
        own=own, days=days,
    )
