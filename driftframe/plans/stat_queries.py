"""Statistics of labels, objects and fluxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftframe.functions import stats
from driftframe.plans import fixtures as fx
from driftframe.plans.registry import query


def r6(df: DataFrame, *columns: str) -> DataFrame:
    """Doubles rounded to 6 places, the named ones or all."""
    names = columns or tuple(c for c, t in df.dtypes if t == "double")
    return df.withColumns({c: F.round(c, 6) for c in names})


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.label(spark, sf_dir).withColumns({"w": fx.area(), "e": F.abs("v") * 0.1 + 0.01}).where("label <> 0")


L = f"with {fx.LABEL}, p as (select *, 1 + 0.01::double * y as w, abs(v) * 0.1::double + 0.01::double as e from label where label <> 0)"


@query(f"{L} select t, label, round(avg(v), 6) as mean, round(stddev_pop(v), 6) as std, round(max(v), 6) as max, round(min(v), 6) as min from p group by all")
def label_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain statistics of each label of each step."""
    return r6(_labelled(spark, sf_dir).groupBy("t", "label").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.max("v").alias("max"), F.min("v").alias("min")))


@query(f"""{L}, c as (select *, sum(v * w) over g / sum(w) over g as m from p window g as (partition by t, label))
select t, label, round(any_value(m), 6) as mean, round(sqrt(sum(w * (v - m) * (v - m)) / sum(w)), 6) as std, round(min(v), 6) as min, round(max(v), 6) as max from c group by t, label""")
def weighted_label_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(stats.weighted_stats(_labelled(spark, sf_dir), ["t", "label"], "v", "w"))


@query(f"""{L}, c as (select *, sum(v * w) over g / sum(w) over g as m from p window g as (partition by t, label)),
s as (select t, label, any_value(m) as mean, sqrt(sum(w * (v - m) * (v - m)) / sum(w) / nullif(1 - sum(w * w) / (sum(w) * sum(w)), 0)) as std, min(v) as min, max(v) as max,
 sqrt(sum(w * w * e * e)) / sum(w) as u, count(*) as n, arg_min(e, {{'v': v, 'e': e}}) as min_error, arg_min(e, {{'v': -v, 'e': e}}) as max_error from c group by t, label)
select t, label, round(mean, 6) as mean, round(std, 6) as std, round(min, 6) as min, round(max, 6) as max, round(u, 6) as mean_uncertainty,
 round(sqrt(std * std / n + u * u), 6) as mean_combined_error, round(min_error, 6) as min_error, round(max_error, 6) as max_error from s where n > 1""")
def weighted_uncertainty_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight statistics with measurement errors, of labels of more than one pixel."""
    rows = _labelled(spark, sf_dir)
    many = rows.groupBy("t", "label").count().where("count > 1").drop("count")
    return r6(stats.weighted_stats_and_uncertainties(rows.join(many, ["t", "label"]), ["t", "label"], "v", "e", "w"))


@query("""with s as (select o_orderpriority as flag, l_returnflag as label, sum(l_quantity) as w from lineitem join orders on l_orderkey = o_orderkey group by all)
select label, flag, round(w / sum(w) over (partition by label), 6) as proportion from s""")
def weighted_proportions(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o = fx.table(spark, sf_dir, "lineitem"), fx.table(spark, sf_dir, "orders")
    rows = li.join(o, li["l_orderkey"] == o["o_orderkey"]).select(F.col("l_returnflag").alias("label"), F.col("o_orderpriority").alias("flag"), "l_quantity")
    return r6(stats.weighted_proportions(rows, ["label"], "flag", "l_quantity"))


@query(f"""with {fx.CUBE}, a as (select t, null::int as y, null::int as x, v from cube)
select 'bulk' as kind, null::int as t, null::int as y, null::int as x, round(avg(v), 6) as mean, round(stddev_pop(v), 6) as std, round(median(v), 6) as median, round(max(v), 6) as max, round(min(v), 6) as min from cube
union all select 'spatial', t, null, null, round(avg(v), 6), round(stddev_pop(v), 6), round(median(v), 6), round(max(v), 6), round(min(v), 6) from cube group by t
union all select 'temporal', null, y, x, round(avg(v), 6), round(stddev_pop(v), 6), round(median(v), 6), round(max(v), 6), round(min(v), 6) from cube group by y, x""")
def bulk_spatial_temporal_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics over everything, for each step and for each pixel, by one grouping-sets aggregation."""
    fx.cube(spark, sf_dir).createOrReplaceTempView("driftframe_cube")
    kind = F.when(F.col("g") == 7, "bulk").when(F.col("g") == 3, "spatial").otherwise("temporal")
    out = spark.sql("""select t, y, x, grouping_id() as g, avg(v) as mean, stddev_pop(v) as std, median(v) as median, max(v) as max, min(v) as min
      from driftframe_cube group by grouping sets ((t, y, x), (), (t), (y, x)) having grouping_id() > 0""")
    return r6(out.select(kind.alias("kind"), "t", "y", "x", "mean", "std", "median", "max", "min"))


@query(f"""with {fx.LABEL} select 'pixel' as kind, null::int as t, y, x, round(avg((label <> 0)::int), 9) as fraction, count(distinct nullif(label, 0)) as n from label group by y, x
union all select 'step', t, null, null, round(avg((label <> 0)::int), 9), count(distinct nullif(label, 0)) from label group by t""")
def label_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of the time and the area labels cover, and how many there are."""
    p = fx.label(spark, sf_dir)
    both = [F.avg((F.col("label") != 0).cast("int")).alias("fraction"), stats.n_unique(F.col("label")).alias("n")]
    pixel = p.groupBy("y", "x").agg(*both).select(F.lit("pixel").alias("kind"), F.lit(None).cast("int").alias("t"), "y", "x", "fraction", "n")
    step = p.groupBy("t").agg(*both).select(F.lit("step").alias("kind"), "t", F.lit(None).cast("int").alias("y"), F.lit(None).cast("int").alias("x"), "fraction", "n")
    return pixel.unionByName(step).withColumn("fraction", F.round("fraction", 9))


@query(f"""with {fx.STEPS}, c as (select *, sum(bt * area) over (partition by core) / sum(area) over (partition by core) as m from steps)
select core, round(any_value(m), 6) as combined_mean, round(sqrt((sum(area * abs(bt) * 0.1::double) + sum(area * (bt - m) * (bt - m))) / sum(area)), 6) as combined_std,
 round(sqrt((sum(area * bt * bt * 0.01::double) + sum(area * (bt - m) * (bt - m))) / sum(area)), 6) as pooled_std from c group by core""")
def combined_mean_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roll-up of step means and deviations, in the literal form and by pooled variances."""
    s = fx.steps(spark, sf_dir).withColumn("std", F.abs("bt") * 0.1)
    both = stats.combined_std(s, ["core"], "std", "bt", "area").join(stats.combined_std(s, ["core"], "std", "bt", "area", True).withColumnRenamed("combined_std", "pooled_std"), "core")
    return r6(stats.combined_mean(s, ["core"], "bt", "area").join(both, "core"))


@query(f"""with {fx.STEPS}, c as (select *, sum(bt * area) over g / sum(area) over g as mx, sum(step * area) over g / sum(area) over g as my from steps window g as (partition by core))
select core, round(sum(area * (bt - mx) * (step - my)) / sum(area), 6) as cov,
 round(sum(area * (bt - mx) * (step - my)) / sum(area) / sqrt(sum(area * (bt - mx) * (bt - mx)) / sum(area) * sum(area * (step - my) * (step - my)) / sum(area)), 6) as corr from c group by core""")
def weighted_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(stats.weighted_covariance(fx.steps(spark, sf_dir).withColumn("step", F.col("step").cast("double")), ["core"], "bt", "step", "area"))


@query(f"with {fx.CUBE} select a.t, round(avg((a.v - b.v) * (a.v - b.v)), 6) as mse, round(avg(case when a.v < 0 then (a.v - b.v) * (a.v - b.v) end), 6) as cold_mse from cube a join cube b on a.t + 1 = b.t and a.y = b.y and a.x = b.x group by a.t")
def frame_mse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean squared difference to the next step, overall and where the field is cold."""
    w = Window.partitionBy("y", "x").orderBy("t")
    p = fx.cube(spark, sf_dir).withColumn("n", F.lead("v").over(w)).where(F.col("n").isNotNull())
    cold = F.when(F.col("v") < 0, F.col("n"))
    return r6(p.groupBy("t").agg(stats.mse(F.col("v"), F.col("n")).alias("mse"), stats.mse(F.col("v"), cold).alias("cold_mse")))


@query(f"""with {fx.STEPS} select core, round(arg_min(area, {{'k': -bt, 's': step}}), 6) as area_at_max, round(arg_min(area, {{'k': bt, 's': step}}), 6) as area_at_min,
 arg_min(step, {{'k': -bt, 's': step}}) as idx_max, arg_min(step, {{'k': bt, 's': step}}) as idx_min, count(*) as n from steps group by core""")
def arg_extrema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another field, and the step, at the largest and smallest value of an object; the first step on ties."""
    s = fx.steps(spark, sf_dir)
    at = lambda v, big: stats.arg_extreme(v, "bt", "step", big)
    return r6(s.groupBy("core").agg(at("area", True).alias("area_at_max"), at("area", False).alias("area_at_min"), at("step", True).alias("idx_max"), at("step", False).alias("idx_min"), F.count(F.lit(1)).alias("n")))


@query(f"""with {fx.STEPS}, l as (select *, (bt - lead(bt, 3) over g) / nullif((lead(t, 3) over g - t) / 60, 0) as r from steps window g as (partition by core order by t))
select core, round(coalesce(max(r), 0), 6) as rate, arg_min(step, {{'k': -r, 't': t}}) filter (r is not null) as idx from l group by core""")
def cooling_rate_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest fall over three steps per minute, and where it starts."""
    return r6(stats.lag_rate(fx.steps(spark, sf_dir), "core", "t", "bt", 3))


@query(f"""with {fx.STEPS}, l as (select *, lag(t) over g as t0, lead(t) over g as t2, lag(bt) over g as f0, lead(bt) over g as f2 from steps window g as (partition by core order by t)),
d as (select core, step, t, case when t0 is null then (f2 - bt) / (t2 - t) when t2 is null then (bt - f0) / (t - t0)
 else ((t - t0) * (t - t0) * f2 + ((t2 - t) * (t2 - t) - (t - t0) * (t - t0)) * bt - (t2 - t) * (t2 - t) * f0) / ((t - t0) * (t2 - t) * (t2 - t0)) end as d from l)
select core, round(-min(d) * 60, 6) as rate, arg_min(step, {{'d': d, 't': t}}) as idx from d group by core""")
def cooling_rate_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steepest cooling per minute by the non-uniform derivative, and its step."""
    w = Window.partitionBy("core").orderBy("t")
    d = fx.steps(spark, sf_dir).withColumn("d", stats.gradient("bt", "t", w))
    return r6(d.groupBy("core").agg((-F.min("d") * 60).alias("rate"), F.min_by("step", F.when(F.col("d").isNotNull(), F.struct("d", "t"))).alias("idx")))


@query("""with f as (select l_suppkey as cell, date_trunc('month', l_shipdate)::date as month, l_extendedprice as allsky, l_extendedprice * (1 - l_discount) as clear, l_quantity as w, l_returnflag from lineitem)
select month, round(sum(w), 6) as total_area, round(sum(w) filter (l_returnflag = 'R'), 6) as dcc_area, round(sum((clear - allsky) * w) / sum(w), 6) as cre,
 round(sum((clear - allsky) * w) filter (l_returnflag = 'R') / nullif(sum(w) filter (l_returnflag = 'R'), 0), 6) as dcc_cre,
 round(sum((clear - allsky) * w) filter (l_returnflag <> 'R') / nullif(sum(w) filter (l_returnflag <> 'R'), 0), 6) as other_cre from f group by month""")
def cre_time_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area and area-weighted radiative effect (clear less all-sky) of a step, and of its flagged part."""
    f = _flux(spark, sf_dir).withColumn("cre", F.col("clear") - F.col("allsky"))
    flagged = F.col("l_returnflag") == "R"
    part = lambda c, v: F.when(c, F.col(v))
    return r6(f.groupBy("month").agg(
        F.sum("w").alias("total_area"), F.sum(part(flagged, "w")).alias("dcc_area"), stats.wmean(F.col("cre"), F.col("w")).alias("cre"),
        stats.wmean(part(flagged, "cre"), F.col("w")).alias("dcc_cre"), stats.wmean(part(~flagged, "cre"), F.col("w")).alias("other_cre"),
    ))


def _flux(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = fx.table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_suppkey").alias("cell"), F.trunc("l_shipdate", "month").alias("month"), F.col("l_extendedprice").alias("allsky"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("clear"), F.col("l_quantity").alias("w"), "l_returnflag",
    )


@query("""with f as (select l_suppkey as cell, date_trunc('month', l_shipdate)::date as month, round(l_extendedprice * 100)::bigint as c, round(l_discount * 100)::bigint as d, l_quantity::bigint as w from lineitem)
select cell, month, sum(c * w)::double / sum(w)::double as allsky, sum(c * d * w)::double / sum(w)::double as cre from f group by all""")
def binned_weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted means of fluxes, and of all-sky less clear, in bins of cell and month; in whole units, so that
    sums are exact in any order."""
    li = fx.table(spark, sf_dir, "lineitem")
    c, d, w = (F.round(F.col(n) * k).cast("long") for n, k in (("l_extendedprice", 100), ("l_discount", 100), ("l_quantity", 1)))
    rows = li.select(F.col("l_suppkey").alias("cell"), F.trunc("l_shipdate", "month").alias("month"), c.alias("allsky"), (c * d).alias("cre"), w.alias("w"))
    return rows.groupBy("cell", "month").agg(*(stats.wmean(F.col(k), F.col("w")).alias(k) for k in ("allsky", "cre")))


@query("""select count(*) as n, round(avg(c - o), 6) as bias, round(stddev_pop(c - o), 6) as std, round(sqrt(avg((c - o) * (c - o))), 6) as rmse, round(corr(c, o), 6) as r,
 round(regr_slope(c, o), 6) as slope, round(regr_intercept(c, o), 6) as intercept, round(sum((c - o) * w) / sum(w), 6) as weighted_bias, round(sqrt(sum((c - o) * (c - o) * w) / sum(w)), 6) as weighted_rmse
from (select l_quantity as c, l_linenumber::double * 7 as o, l_tax + 1 as w from lineitem)""")
def bias_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bias, deviation, RMSE, correlation and line of estimates against truths."""
    li = fx.table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("c"), (F.col("l_linenumber").cast("double") * 7).alias("o"), (F.col("l_tax") + 1).alias("w"))
    return r6(stats.bias_stats(li, "c", "o", "w"))


@query(f"""with {fx.STEPS}, n as (select *, case when step % 11 = 0 then null else bt end as b from steps)
select core, round(case when count(b) = count(*) then sum(b * area) / sum(area) end, 6) as strict, round(sum(b * area) / sum(area) filter (b is not null), 6) as lenient,
 round(sqrt(sum(area * area * bt * bt)) / sum(area), 6) as uncertainty from n group by core""")
def weighted_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted means that a missing value spoils, that skip it, and the uncertainty of the mean."""
    s = fx.steps(spark, sf_dir).withColumn("b", F.when(F.col("step") % 11 != 0, F.col("bt")))
    b, a = F.col("b"), F.col("area")
    return r6(s.groupBy("core").agg(stats.strict_mean(b, a).alias("strict"), stats.wmean(b, a).alias("lenient"), stats.weighted_uncertainty(F.col("bt"), a).alias("uncertainty")))


@query(f"""{L}, c as (select *, sum(v * w) over g / sum(w) over g as m from p window g as (partition by label))
select label, round(any_value(m), 6) as label_v_mean, round(sqrt(sum(w * (v - m) * (v - m)) / sum(w) / nullif(1 - sum(w * w) / (sum(w) * sum(w)), 0)), 6) as label_v_std, round(min(v), 6) as label_v_min, round(max(v), 6) as label_v_max from c group by label""")
def named_label_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics under names made of the dimension, the field and the statistic."""
    from driftframe.functions.attributes import named_stats

    return r6(named_stats(_labelled(spark, sf_dir), "label", ["v"], "w"))


@query("""with s as (select l_returnflag as label, l_linenumber % 4 as value, sum(l_quantity) as w from lineitem group by all), f as (select * from (values (0, 'clear'), (1, 'water'), (2, 'ice'), (9, 'other')) _(value, meaning)),
e as (select distinct label from s) select e.label, meaning, round(coalesce(w / (select sum(w) from s z where z.label = e.label), 0), 6) as label_phase_proportion from e cross join f left join s on s.label = e.label and s.value = f.value""")
def named_proportions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proportions of every value of a flag that its attributes name."""
    from driftframe.functions import attributes

    rows = fx.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("label"), (F.col("l_linenumber") % 4).alias("phase"), F.col("l_quantity").alias("w"))
    flags = attributes.flag_table(spark, "0b 1b 2b 9b", "0:clear 1:water 2:ice 9:other")
    return r6(attributes.named_proportions(rows, "label", "phase", "w", flags))
