"""Fields, stencils, morphology and scaling of the cube."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftframe.functions import normalise
from driftframe.operators import morphology, stencil
from driftframe.plans import fixtures as fx
from driftframe.plans.registry import query
from driftframe.plans.stat_queries import r6


def _o(offsets) -> str:
    rows = ", ".join(f"({i}, {t}, {y}, {x})" for i, (t, y, x) in enumerate(offsets))
    return f"o as (select * from (values {rows}) as _(tap, dt, dy, dx))"


NEAREST = """taps as (select f.t, f.y, f.x, tap, s.v as value from flow f cross join o left join {src} s on s.t = f.t + dt
  and s.y = f.y + dy + case dt when 1 then fy when -1 then "by" else 0 end and s.x = f.x + dx + case dt when 1 then fx when -1 then bx else 0 end)"""
STILL = "taps as (select f.t, f.y, f.x, tap, s.{v} as value from {src} f cross join o left join {src} s on s.t = f.t + dt and s.y = f.y + dy and s.x = f.x + dx)"
ENDS = [(-1, 0, 0), (1, 0, 0)]
DIFF = """d as (select c.t, c.y, c.x, case when c.v is not null then (coalesce(n.value - c.v, 0) + coalesce(c.v - p.value, 0)) / greatest((n.value is not null)::int + (p.value is not null)::int, 1) end as value
  from {src} c join taps n on n.tap = 1 and n.t = c.t and n.y = c.y and n.x = c.x join taps p on p.tap = 0 and p.t = c.t and p.y = c.y and p.x = c.x)"""
SQUARE = [(0, y, x) for y in (-1, 0, 1) for x in (-1, 0, 1)]


@query(f"with {fx.HOLED}, {_o(SQUARE)}, {STILL.format(src='holed', v='v')} select t, y, x, round(avg(value), 6) as mean, count(value) as n from taps group by t, y, x")
def same_step_stencil(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = stencil.taps(fx.holed(spark, sf_dir), None, SQUARE)
    return r6(got.groupBy("t", "y", "x").agg(F.avg("value").alias("mean"), F.count("value").alias("n")))


@query(f"with {fx.FLOW}, {_o([(1, 0, 0)])}, {NEAREST.format(src='cube')} select t, y, x, value from taps")
def warp_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencil.taps(fx.cube(spark, sf_dir), fx.flow(spark, sf_dir), [(1, 0, 0)]).drop("tap")


@query(f"""with {fx.HALF}, p as (select t, y, x, t + 1 as st, y + fy as py, x + fx as px from half),
c as (select t, y, x, st, (floor(py) + i)::int as sy, (floor(px) + j)::int as sx, (case i when 1 then py - floor(py) else 1 - (py - floor(py)) end) * (case j when 1 then px - floor(px) else 1 - (px - floor(px)) end) as w
  from p cross join (values (0, 0), (0, 1), (1, 0), (1, 1)) k(i, j))
select c.t, c.y, c.x, round(case when count(*) = count(v) then sum(w * v) end, 6) as value from c left join cube s on s.t = st and s.y = sy and s.x = sx where w > 0 group by c.t, c.y, c.x""")
def warp_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(stencil.taps(fx.cube(spark, sf_dir), fx.flow(spark, sf_dir, 0.5), [(1, 0, 0)], "linear").drop("tap"))


def _resampled(weight: str, low: int, high: int) -> str:
    """SQL of samples along the half flow; ``weight`` is that of a pixel at a distance ``{d}``."""
    return f"""with {fx.HALF}, p as (select t, y, x, t + 1 as st, y + fy as py, x + fx as px from half),
a as (select *, floor(py)::int + i as sy, floor(px)::int + j as sx, abs(py - floor(py) - i) as dy, abs(px - floor(px) - j) as dx from p cross join range({low}, {high + 1}) r(i) cross join range({low}, {high + 1}) q(j)),
b as (select *, {weight.format(d="dy")} * {weight.format(d="dx")} as w1 from a),
n as (select *, w1 / sum(w1) over (partition by t, y, x) as w from b where abs(w1) > 1e-12)
select n.t, n.y, n.x, round(case when count(*) = count(v) then sum(w * v) end, 6) as value from n left join cube s on s.t = st and s.y = sy and s.x = sx group by n.t, n.y, n.x"""


@query(_resampled("(case when {d} <= 1 then 1.25 * {d} * {d} * {d} - 2.25 * {d} * {d} + 1 else -0.75 * {d} * {d} * {d} + 3.75 * {d} * {d} - 6 * {d} + 3 end)", -1, 2))
def warp_cubic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(stencil.taps(fx.cube(spark, sf_dir), fx.flow(spark, sf_dir, 0.5), [(1, 0, 0)], "cubic").drop("tap"))


@query(_resampled("(case when {d} = 0 then 1 when {d} = floor({d}) then 0 else sin(pi() * {d}) * sin(pi() * {d} / 4) * 4 / (pi() * {d}) ** 2 end)", -3, 4))
def warp_lanczos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(stencil.taps(fx.cube(spark, sf_dir), fx.flow(spark, sf_dir, 0.5), [(1, 0, 0)], "lanczos").drop("tap"))


@query(f"""with {fx.FLOW}, b as (select f.t, f.y, f.x, c.v as nearest, r.v as reflect, m.v as mirror, w.v as wrap from flow f
 left join cube c on c.t = f.t + 1 and c.y = least(greatest(f.y + 3 * fy, 0), 19) and c.x = least(greatest(f.x + 3 * fx, 0), 63)
 left join cube r on r.t = f.t + 1 and r.y = case when f.y + 3 * fy < 0 then -1 - f.y - 3 * fy when f.y + 3 * fy > 19 then 39 - f.y - 3 * fy else f.y + 3 * fy end and r.x = case when f.x + 3 * fx < 0 then -1 - f.x - 3 * fx when f.x + 3 * fx > 63 then 127 - f.x - 3 * fx else f.x + 3 * fx end
 left join cube m on m.t = f.t + 1 and m.y = case when f.y + 3 * fy > 19 then 38 - f.y - 3 * fy else abs(f.y + 3 * fy) end and m.x = case when f.x + 3 * fx > 63 then 126 - f.x - 3 * fx else abs(f.x + 3 * fx) end
 left join cube w on w.t = f.t + 1 and w.y = (f.y + 3 * fy + 20) % 20 and w.x = (f.x + 3 * fx + 64) % 64) select * from b""")
def warp_borders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples beyond the border, brought back inside in four ways."""
    c, f = fx.cube(spark, sf_dir), fx.flow(spark, sf_dir, 3.0)
    out = None
    for border in stencil.BORDERS[1:]:
        one = stencil.taps(c, f, [(1, 0, 0)], border=border).select("t", "y", "x", F.col("value").alias(border))
        out = one if out is None else out.join(one, ["t", "y", "x"])
    return out


F_HOLED = fx.FLOW + ", " + fx.HOLED.removeprefix(fx.CUBE + ", ")


@query(f"with {F_HOLED}, {_o(ENDS)}, {NEAREST.format(src='holed')}, {DIFF.format(src='holed')} select t, y, x, round(value, 6) as value from d")
def lagrangian_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(stencil.diff(fx.holed(spark, sf_dir), fx.flow(spark, sf_dir), "nearest"))


@query(f"""with {fx.FLOW}, {_o(ENDS)}, {NEAREST.format(src='cube')}, {DIFF.format(src='cube')},
m as (select t, y, x, value as v from d), q as (select * from (values (0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)) _(dy, dx))
select m.t, m.y, m.x, round(avg(s.v), 6) as value from m cross join q join m s on s.t = m.t and s.y = m.y + dy and s.x = m.x + dx group by m.t, m.y, m.x""")
def growth_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(stencil.growth_rate(fx.cube(spark, sf_dir), fx.flow(spark, sf_dir), "nearest"))


@query(f"with {F_HOLED}, {_o([(-1, 0, 0), (0, 0, 0), (1, 0, 0)])}, {NEAREST.format(src='holed')} select t, y, x, round(case when max(case when tap = 1 then value end) is not null then avg(value) end, 6) as value from taps group by t, y, x")
def filtered_tdiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(stencil.filtered_tdiff(fx.holed(spark, sf_dir), fx.flow(spark, sf_dir), "nearest"))


def _sobel_sql(d: str, digits: int = 6) -> str:
    w = {-1: 1, 0: 2, 1: 1}
    rows = ", ".join(f"({i}, {t}, {y}, {x}, {t * w[y] * w[x]}, {y * w[t] * w[x]}, {x * w[t] * w[y]})" for i, (t, y, x) in enumerate(stencil.full()))
    return f"""with {fx.FLOW}, o as (select * from (values {rows}) as _(tap, dt, dy, dx, wt, wy, wx)), {NEAREST.format(src='cube')},
g as (select k.t, k.y, k.x, {d} as d, wt, wy, wx from taps k join o using (tap) join cube c on c.t = k.t and c.y = k.y and c.x = k.x)
select t, y, x, round(sqrt(coalesce(sum(d * wt), 0) ** 2 + coalesce(sum(d * wy), 0) ** 2 + coalesce(sum(d * wx), 0) ** 2), {digits}) as value from g group by t, y, x"""


@query(_sobel_sql("value - v"))
def sobel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(stencil.sobel(fx.cube(spark, sf_dir), fx.flow(spark, sf_dir)))


@query(_sobel_sql("greatest(coalesce(value - v, 0), 0)"))
def sobel_uphill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(stencil.sobel(fx.cube(spark, sf_dir), fx.flow(spark, sf_dir), "uphill"))


@query(_sobel_sql("least(coalesce(value - v, 0), 0)"))
def sobel_downhill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(stencil.sobel(fx.cube(spark, sf_dir), fx.flow(spark, sf_dir), "downhill"))


@query(f"""select t, y, x, round(case when s.value > 0 then s.value + 1 else s.value end - v, 5) as value from ({_sobel_sql("greatest(coalesce(value - v, 0), 0)", 12)}) s join (with {fx.CUBE} select * from cube) c using (t, y, x)""")
def edge_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uphill edges less the field, to flood over."""
    return stencil.edge_field(fx.cube(spark, sf_dir), fx.flow(spark, sf_dir), "nearest").withColumn("value", F.round("value", 5))


@query(f"with {fx.FLOW}, {_o(stencil.full(1))}, {NEAREST.format(src='cube')}, m as (select t, y, x, min(value) as m from taps group by t, y, x) select t, y, x, v = m as value from cube join m using (t, y, x)")
def local_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels that are the least of their neighbours along the flow."""
    return stencil.local_min(fx.cube(spark, sf_dir), fx.flow(spark, sf_dir), stencil.full(1))


@query(f"""with {fx.FLOW}, k as (select * from flow union all select t, y, x, 2.0 * fy, 0.5 * fx, 2.0 * "by", 0.5 * bx from flow),
w as (select *, sqrt(fx * fx + fy * fy) as f, sqrt(bx * bx + "by" * "by") as b from k)
select t, y, x, round(sum(fx * f) / nullif(sum(f), 0), 6) as fx, round(sum(fy * f) / nullif(sum(f), 0), 6) as fy, round(sum(bx * b) / nullif(sum(b), 0), 6) as bx, round(sum("by" * b) / nullif(sum(b), 0), 6) as "by" from w group by t, y, x""")
def combine_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fx.flow(spark, sf_dir)
    other = f.select("t", "y", "x", (2.0 * F.col("fy")).alias("fx"), (0.5 * F.col("fx")).alias("fy"), (2.0 * F.col("by")).alias("bx"), (0.5 * F.col("bx")).alias("by"))
    return r6(stencil.combine_flow(f, other))


@query(f"with {fx.FLOW} select t, y, x, round(sqrt(fx * fx + fy * fy), 6) as value from flow")
def flow_magnitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(stencil.magnitude(fx.flow(spark, sf_dir)))


@query(f"""with {fx.FLOW} select t, y, x, round((0.375 * fx - 0.125 * bx)::double, 6) as dx, round((0.375 * fy - 0.125 * "by")::double, 6) as dy from flow""")
def parabolic_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Displacement half a step ahead."""
    return r6(stencil.parabolic(fx.flow(spark, sf_dir), 0.5))


@query(f"""with {fx.FLOW}, n as (select f.*, s.bx as rx, s."by" as ry, p.fx as qx, p.fy as qy from flow f left join flow s on s.t = f.t + 1 and s.y = f.y + f.fy and s.x = f.x + f.fx
  left join flow p on p.t = f.t - 1 and p.y = f.y + f."by" and p.x = f.x + f.bx)
select t, y, x, round(coalesce((fx - rx) / 2, fx), 6) as fx, round(coalesce((fy - ry) / 2, fy), 6) as fy, round(coalesce((bx - qx) / 2, bx), 6) as bx, round(coalesce(("by" - qy) / 2, "by"), 6) as "by" from n""")
def smooth_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(stencil.smooth_flow(fx.flow(spark, sf_dir), "nearest"))


@query(f"""with {fx.FLOW}, {_o(stencil.full(1))}, {NEAREST.format(src='cube')}, m as (select t, y, x, min(value) as m, arg_min(value, {{'k': value, 'p': tap}}) as v from taps group by t, y, x)
select t, y, x, m.v as value, c.v = m.m as lowest from m join cube c using (t, y, x)""")
def stencil_argmin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value at the least tap of the stencil, and whether the centre is the least."""
    c, f = fx.cube(spark, sf_dir), fx.flow(spark, sf_dir)
    low = stencil.local_min(c, f, stencil.full(1)).withColumnRenamed("value", "lowest")
    return stencil.argmin_tap(c, c, f, stencil.full(1)).join(low, ["t", "y", "x"])


@query(f"""with {fx.CUBE}, n as (select c.t, c.y, c.x, c.v, s.v as n from cube c left join cube s on s.t = c.t + 1 and s.y = c.y and s.x = c.x) select t, case when count(n) = 0 then null else round(max(abs(n - v)), 6) end as jump from n group by t""")
def frame_jump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest change of a pixel to the next step."""
    c = fx.cube(spark, sf_dir)
    still = c.select("t", "y", "x", *(F.lit(0.0).alias(k) for k in ("fx", "fy", "bx", "by")))
    n = stencil.taps(c, still, [(1, 0, 0)]).join(c, ["t", "y", "x"])
    return r6(n.groupBy("t").agg(F.max(F.abs(F.col("value") - F.col("v"))).alias("jump")))


def _mask_sql(offsets, agg: str, source: str = "mask", extra: str = "") -> str:
    return f"{_o(offsets)}, {STILL.format(src=source, v='m')}{extra}, r as (select t, y, x, {agg} as m from taps group by t, y, x)"


ERODE, DILATE = "bool_and(coalesce(value, false))", "bool_or(coalesce(value, false))"


@query(f"with {fx.MASK}, {_mask_sql(stencil.CROSS, ERODE)} select * from r")
def erosion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return morphology.erode(fx.mask(spark, sf_dir))


@query(f"with {fx.MASK}, {_mask_sql(stencil.full(), DILATE)} select * from r")
def dilation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return morphology.dilate(fx.mask(spark, sf_dir), stencil.full())


@query(f"""with {fx.MASK}, {_mask_sql(stencil.CROSS, ERODE)} , u as (select f.t, f.y, f.x, s.m as value from r f cross join o left join r s on s.t = f.t + dt and s.y = f.y + dy and s.x = f.x + dx)
select t, y, x, {DILATE} as m from u group by t, y, x""")
def opening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return morphology.opening(fx.mask(spark, sf_dir))


@query(f"""with {fx.CUBE}, {_o(stencil.CROSS)}, {STILL.format(src='cube', v='v')}, r as (select t, y, x, min(value) as v from taps group by t, y, x),
u as (select f.t, f.y, f.x, s.v as value from r f cross join o join r s on s.t = f.t + dt and s.y = f.y + dy and s.x = f.x + dx) select t, y, x, max(value) as v from u group by t, y, x""")
def grey_opening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return morphology.grey_opening(fx.cube(spark, sf_dir))


@query(f"""with {fx.HOLED}, mask as (select t, y, x, coalesce(v <= 0, true) as m from holed), {_mask_sql(stencil.full(), "bool_and(coalesce(value, true))")}
select t, y, x, m or v is null as m from r join holed using (t, y, x)""")
def watershed_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return morphology.watershed_mask(fx.holed(spark, sf_dir))


@query(f"with {fx.HOLED} select t, y, x, round(least(greatest((v + 0.1) / 0.3, 0), 1), 6) + v * 0 as up, round(1 - least(greatest((v + 0.1) / 0.3, 0), 1), 6) + v * 0 as down from holed")
def linearise(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    return r6(fx.holed(spark, sf_dir).select("t", "y", "x", normalise.linearise(v, -0.1, 0.2).alias("up"), normalise.linearise(v, 0.2, -0.1).alias("down")))


@query(f"with {fx.CUBE} select t, y, x, round((v - min(v) over g) / (max(v) over g - min(v) over g), 6) as v from cube window g as (partition by t)")
def norm_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(normalise.linear_norm(fx.cube(spark, sf_dir), ["t"]))


@query(f"with {fx.CUBE}, z as (select t, y, x, (v - avg(v) over g) / stddev_pop(v) over g as z from cube window g as (partition by t)) select t, y, x, round(least(greatest((z + 3) / 6, 0), 1), 6) as v from z")
def norm_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(normalise.z_norm(fx.cube(spark, sf_dir), ["t"]))


@query(f"""with {fx.CUBE}, l as (select t, y, x, ln(v - min(v) over g + 1) as l from cube window g as (partition by t)) select t, y, x, round(l / max(l) over (partition by t), 6) as v from l""")
def norm_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(normalise.log_norm(fx.cube(spark, sf_dir), ["t"], fixed=True))


@query(f"""with {fx.CUBE}, l as (select t, y, x, ln(max(v) over g - v + 1) as l from cube window g as (partition by t)) select t, y, x, round(l / max(l) over (partition by t), 6) as v from l""")
def norm_inverse_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(normalise.inverse_log_norm(fx.cube(spark, sf_dir), ["t"], fixed=True))


@query(f"""with {fx.CUBE}, e as (select t, quantile_cont(v, [i / 16.0 for i in range(17)]) as e from cube group by t),
b as (select c.t, y, x, least(len(list_filter(e, lambda q: q <= v)), 16) as b from cube c join e on c.t = e.t) select t, y, x, round((b - min(b) over g) / (max(b) over g - min(b) over g), 6) as v from b window g as (partition by t)""")
def norm_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(normalise.uniform_norm(fx.cube(spark, sf_dir), ["t"], quantiles=16))


#: Rows and columns of the squares, and the pixels of one before and after its own.
SIDE, REST = 10, "rows between 5 preceding and 4 following"


@query(f"""with {fx.HOLED}, f as (select t, y, x, coalesce(v, avg(v) over (partition by t)) as v from holed),
r as (select *, min(v) over w as lo, max(v) over w as hi from f window w as (partition by t, y order by x {REST})),
c as (select t, y, x, v, min(lo) over w as lo, max(hi) over w as hi from r window w as (partition by t, x order by y {REST}))
select t, y, x, round(case when hi > lo then (v - lo) / (hi - lo) else 0 end, 6) as v from c""")
def norm_local_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaling by the extremes around each pixel."""
    return r6(normalise.local_linear_norm(fx.holed(spark, sf_dir), ["t"], size=SIDE))


@query(f"with {fx.HOLED} select t, y, x, coalesce(floor((v - min(v) over g) * (255 / (max(v) over g - min(v) over g))), 127)::int as v from holed window g as (partition by t)")
def to_8bit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalise.to_8bit(fx.holed(spark, sf_dir), ["t"])
