"""Geometry, regridding and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftframe.functions import geo
from driftframe.operators import regrid, validation
from driftframe.plans import fixtures as fx
from driftframe.plans.registry import query
from driftframe.plans.stat_queries import r6
from driftframe.sources import files


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    return s.select(k.alias("k"), ((k * 37) % 140 - 70 + 0.25).alias("lat"), ((k * 53) % 120 - 135 + 0.5).alias("lon"))


PLACES = "places as (select s_suppkey as k, (s_suppkey * 37 % 140 - 70 + 0.25)::double as lat, (s_suppkey * 53 % 120 - 135 + 0.5)::double as lon from supplier)"


#: The sun at 18:30 on day 151; the coefficients are written out, apart from those of the library.
SUN = PLACES + """, u as (select k, lat, lon, 2 * pi() * 151 / 365 as a, 2 * pi() * 151 / 366 as e from places),
d as (select k, radians(lat) as p, lon, 0.006918 - 0.399912 * cos(a) - 0.006758 * cos(2 * a) - 0.002697 * cos(3 * a) + 0.070257 * sin(a) + 0.000907 * sin(2 * a) + 0.001480 * sin(3 * a) as dec,
  0.0072 * cos(e) - 0.0528 * cos(2 * e) - 0.0012 * cos(3 * e) - 0.1229 * sin(e) - 0.1565 * sin(2 * e) - 0.0041 * sin(3 * e) as eqt from u),
h as (select *, radians(15 * (18.5 + lon / 15 + eqt - 12)) as h from d),
z as (select *, asin(sin(dec) * sin(p) + cos(dec) * cos(p) * cos(h)) as height, sin(dec) * cos(p) - cos(dec) * sin(p) * cos(h) as north from h)"""


@query(f"""with {SUN} select k, round(90 - degrees(height), 6) as zenith, round(degrees(acos(least(greatest(north / cos(height), -1), 1))), 4) as azimuth,
 round((degrees(atan2(-cos(dec) * sin(h), north)) + 360) % 360, 6) as bearing from z""")
def solar_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position of the sun at 18:30 on the last of May."""
    p = _places(spark, sf_dir).withColumn("ts", F.lit("2018-05-31 18:30:00").cast("timestamp_ntz"))
    (z, a), (_, b) = (geo.solar_angles(F.col("ts"), F.col("lat"), F.col("lon"), full_circle=full) for full in (False, True))
    return r6(p.select("k", z.alias("zenith"), F.round(a, 4).alias("azimuth"), b.alias("bearing")))


@query(f"""with {PLACES}, c as (select k, radians(lat) as p, radians(lon + 75) as d, cos(radians(lat)) * cos(radians(lon + 75)) as c from places)
select k, round(degrees(atan2(sqrt(1 - c * c), c - 6371.0 / 42164.0)), 6) as zenith, round((degrees(atan2(-sin(d), -sin(p) * cos(d))) + 360) % 360, 6) as azimuth from c""")
def satellite_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    z, a = geo.viewing_angles(F.col("lat"), F.col("lon"), 0.0, -75.0)
    return r6(_places(spark, sf_dir).select("k", z.alias("zenith"), a.alias("azimuth")))


A, B = geo.GRS80
GEOS = f"""{PLACES}, g as (select k, lat, lon, atan(tan(radians(lat)) * {B * B / (A * A)!r}) as p, radians(lon + 75) as d from places),
r as (select *, {B!r} / sqrt(1 - {1 - B * B / (A * A)!r} * cos(p) * cos(p)) as r from g),
s as (select *, {A + geo.SATELLITE_HEIGHT!r} - r * cos(p) * cos(d) as sx, -r * cos(p) * sin(d) as sy, r * sin(p) as sz from r)"""


@query(f"""with {GEOS} select k, case when {A + geo.SATELLITE_HEIGHT!r} * ({A + geo.SATELLITE_HEIGHT!r} - sx) >= sy * sy + {A * A / (B * B)!r} * sz * sz then round(asin(-sy / sqrt(sx * sx + sy * sy + sz * sz)), 9) end as x,
 case when {A + geo.SATELLITE_HEIGHT!r} * ({A + geo.SATELLITE_HEIGHT!r} - sx) >= sy * sy + {A * A / (B * B)!r} * sz * sz then round(atan(sz / sx), 9) end as y from s""")
def geos_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = geo.geos_forward(F.col("lat"), F.col("lon"))
    return _places(spark, sf_dir).select("k", F.round(x, 9).alias("x"), F.round(y, 9).alias("y"))


@query(f"""with {GEOS} select k, round(lat, 6) as lat, round(lon, 6) as lon from s where {A + geo.SATELLITE_HEIGHT!r} * ({A + geo.SATELLITE_HEIGHT!r} - sx) >= sy * sy + {A * A / (B * B)!r} * sz * sz""")
def geos_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places on the visible disc, projected and back."""
    x, y = geo.geos_forward(F.col("lat"), F.col("lon"))
    p = _places(spark, sf_dir).withColumns({"x": x, "y": y}).where("x is not null")
    lat, lon = geo.geos_inverse(F.col("x"), F.col("y"))
    return p.select("k", F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"))


@query(f"with {PLACES} select k, round(lon, 6) as lon, round(lat, 6) as lat, round(k::double, 3) as alt from places")
def ecef_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geodetic coordinates to geocentric ones and back."""
    p = _places(spark, sf_dir)
    x, y, z = geo.to_ecef(F.col("lon"), F.col("lat"), F.col("k").cast("double"))
    p = p.select("k", x.alias("x"), y.alias("y"), z.alias("z"))
    lon, lat, alt = geo.from_ecef(F.col("x"), F.col("y"), F.col("z"))
    return p.select("k", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"), F.round(alt, 3).alias("alt"))


LA, LB = geo.LIGHTNING
LH, GH = LA + geo.SATELLITE_HEIGHT, A + geo.SATELLITE_HEIGHT


@query(f"""with {PLACES}, g as (select k, lat, lon, atan(tan(radians(lat)) * {LB * LB / (LA * LA)!r}) as p, radians(lon + 75) as d from places), r as (select *, {LB!r} / sqrt(1 - {1 - LB * LB / (LA * LA)!r} * cos(p) * cos(p)) as r from g),
s as (select *, {LH!r} - r * cos(p) * cos(d) as sx, -r * cos(p) * sin(d) as sy, r * sin(p) as sz from r),
a as (select k, lat, lon, case when {LH!r} * ({LH!r} - sx) >= sy * sy + {LA * LA / (LB * LB)!r} * sz * sz then asin(-sy / sqrt(sx * sx + sy * sy + sz * sz)) end as x, case when {LH!r} * ({LH!r} - sx) >= sy * sy + {LA * LA / (LB * LB)!r} * sz * sz then atan(sz / sx) end as y from s),
q as (select *, sin(x) ** 2 + cos(x) ** 2 * (cos(y) ** 2 + {A * A / (B * B)!r} * sin(y) ** 2) as aa, -2 * {GH!r} * cos(x) * cos(y) as bb, {GH * GH - A * A!r} as cc from a),
w as (select *, bb * bb - 4 * aa * cc as disc, (-bb - sqrt(greatest(bb * bb - 4 * aa * cc, 0))) / (2 * aa) as rs from q),
e as (select *, rs * cos(x) * cos(y) as ex, -rs * sin(x) as ey, rs * cos(x) * sin(y) as ez from w)
select k, case when disc >= 0 then round(lon - (-75 - degrees(atan(ey / ({GH!r} - ex)))), 6) end as dlon, case when disc >= 0 then round(lat - degrees(atan({A * A / (B * B)!r} * ez / sqrt(({GH!r} - ex) ** 2 + ey * ey))), 6) end as dlat from e""")
def lightning_parallax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shift between the ellipsoid of lightning and the grid's."""
    lon, lat = geo.parallax_offsets(F.col("lon"), F.col("lat"))
    return r6(_places(spark, sf_dir).select("k", lon.alias("dlon"), lat.alias("dlat")))


@query(f"""with {fx.STEPS}, p as (select core, t, step, 10 + bt / 100 as lat, area as lon from steps), l as (select *, lead(lat) over g as la, lead(lon) over g as lo, lead(t) over g as tt from p window g as (partition by core order by t)),
r as (select *, radians(lat) as a, radians(la) as b, radians(lo) - radians(lon) as d from l where la is not null),
v as (select core, case when lat <> la or lon <> lo then atan2(sin(d) * cos(b), cos(a) * sin(b) - sin(a) * cos(b) * cos(d)) end as az,
 2 * 6371000.0 * asin(sqrt(sin((b - a) / 2) ** 2 + cos(a) * cos(b) * sin(d / 2) ** 2)) / nullif(tt - t, 0) as speed from r)
select core, round(degrees(atan2(avg(sin(az)), avg(cos(az)))), 6) as azimuth, round(avg(speed), 6) as speed from v group by core""")
def azimuth_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean direction and speed of objects, on a sphere."""
    from driftframe.operators.entities import roll_up

    s = fx.steps(spark, sf_dir).withColumns({"lat": 10 + F.col("bt") / 100, "lon": F.col("area")})
    return r6(roll_up(s, "core", "c", rates=False).select("core", F.col("c_propagation_direction").alias("azimuth"), F.col("c_propagation_speed").alias("speed")))


def _vincenty(points: str, rounds: int = 8) -> str:
    """CTEs from ``points`` (``k, lat1, lon1, lat2, lon2``) to ``geodesic`` (``k, km``); the rounds are written out."""
    a, b = 6378137.0, 6356752.314245179
    f = (a - b) / a
    angles = """sqrt((c2 * sin(l)) ** 2 + (c1 * s2 - s1 * c2 * cos(l)) ** 2) as ss, s1 * s2 + c1 * c2 * cos(l) as cs"""
    out = f"""{points}, v0 as (select *, sin(u1) as s1, cos(u1) as c1, sin(u2) as s2, cos(u2) as c2, span as l from (select k, atan({1 - f!r} * tan(radians(lat1))) as u1, atan({1 - f!r} * tan(radians(lat2))) as u2, radians(lon2) - radians(lon1) as span from points))"""
    for n in range(rounds + 1):
        out += f""", a{n} as (select *, {angles} from v{n}), b{n} as (select *, case when ss > 0 then c1 * c2 * sin(l) / ss else 0 end as sa from a{n}), d{n} as (select *, 1 - sa * sa as q from b{n}),
e{n} as (select *, case when q > 1e-15 then cs - 2 * s1 * s2 / q else 0 end as cm, {f!r} / 16 * q * (4 + {f!r} * (4 - 3 * q)) as c from d{n})"""
        if n < rounds:
            out += f", v{n + 1} as (select k, s1, c1, s2, c2, span, span + (1 - c) * {f!r} * sa * (atan2(ss, cs) + c * ss * (cm + c * cs * (2 * cm * cm - 1))) as l from e{n})"
    return out + f""", w as (select *, q * {(a * a - b * b) / (b * b)!r} as w from e{rounds}), g as (select *, 1 + w / 16384 * (4096 + w * (-768 + w * (320 - 175 * w))) as p, w / 1024 * (256 + w * (-128 + w * (74 - 47 * w))) as r from w),
geodesic as (select k, {b!r} * p * (atan2(ss, cs) - r * ss * (cm + r / 4 * (cs * (2 * cm * cm - 1) - r / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))) / 1000 as km from g)"""


@query(f"with {PLACES}, {_vincenty('points as (select k, lat as lat1, lon as lon1, lat + 1 as lat2, lon + 1 as lon2 from places)')} select k, round(km, 6) as km from geodesic")
def geodesic_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance on the ellipsoid between places."""
    p = _places(spark, sf_dir)
    d = geo.geodesic(F.col("lat"), F.col("lon"), F.col("lat") + 1, F.col("lon") + 1)
    return r6(p.select("k", d.alias("km")))


FLASH = "flash as (select epoch_us(ts) / 1e6 as s, user_id % 20 as y, event_id % 64 as x from events where event_type = 'error'), scan as (select i as t, m + i * 21600.0 as s from (select m, unnest(range(n + 1)) as i from (select min(epoch_us(ts)) / 1e6 as m, ceil((max(epoch_us(ts)) - min(epoch_us(ts))) / 21600e6)::bigint as n from events)))"
SPAN = "span as (select t, s, s - least(coalesce(s - lag(s) over g, lead(s) over g - s), 10800) / 2 as lo, s + least(coalesce(lead(s) over g - s, s - lag(s) over g), 10800) / 2 as hi from scan window g as (order by s))"


def _flashes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = fx.table(spark, sf_dir, "events")
    s = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    flash = e.where("event_type = 'error'").select(s.alias("s"), (F.col("user_id") % 20).alias("y"), (F.col("event_id") % 64).alias("x"))
    span = e.agg(F.min(s).alias("m"), F.ceil((F.max(s) - F.min(s)) / 21600).alias("n"))  # a scan every six hours
    scan = span.select("m", F.explode(F.sequence(F.lit(0).cast("long"), "n")).alias("t")).select("t", (F.col("m") + F.col("t") * 21600.0).alias("s"))
    return flash, scan


@query(f"with {FLASH}, {SPAN} select t, y, x, count(*) as n from flash f join span w on f.s > w.lo and f.s < w.hi group by t, y, x")
def interval_join_gridding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flashes counted on cells and steps, each step taking half of the time to its neighbours."""
    flash, scan = _flashes(spark, sf_dir)
    return regrid.interval_join(flash, regrid.windows(scan, 10800.0), slot=10800.0).groupBy("t", "y", "x").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {FLASH}, w as (select t, m.s - 10800 as lo, m.s + 10800 as hi from scan m) select t, y, x, count(*) as n from flash f join w on f.s >= w.lo and f.s < w.hi group by t, y, x")
def half_open_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flashes of spans that hold their beginnings."""
    flash, scan = _flashes(spark, sf_dir)
    spans = scan.select("t", (F.col("s") - 10800).alias("lo"), (F.col("s") + 10800).alias("hi"))
    return regrid.interval_join(flash, spans, slot=10800.0, closed_left=True).groupBy("t", "y", "x").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {PLACES}, b as (select min(lat) + 20.0 as lat0, max(lat) - 20.0 as lat1, min(lon) + 20.0 as lon0, max(lon) - 20.0 as lon1 from places) select k, lat, lon from places, b where lat > lat0 - 0.005 and lat < lat1 + 0.005 and lon > lon0 - 0.005 and lon < lon1 + 0.005")
def sites_inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _places(spark, sf_dir)
    box = p.agg(*((f(c) + d).alias(f"{c}{k}") for c in ("lat", "lon") for f, d, k in ((F.min, 20.0, 0), (F.max, -20.0, 1))))
    return regrid.sites_inside(p.select("k", "lat", "lon"), box)


@query(f"""with {FLASH}, p as (select f.s, f.y, f.x, k.t, abs(k.s - f.s) as d, k.s as ks from flash f left join scan k on abs(k.s - f.s) <= 7200)
select round(s, 6) as s, y, x, arg_min(t, {{'d': d, 'k': ks}}) filter (t is not null) as t from p group by s, y, x""")
def asof_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each flash with the nearest scan within two hours."""
    flash, scan = _flashes(spark, sf_dir)
    return regrid.asof_nearest(flash, scan, 7200.0).select(F.round("s", 6).alias("s"), "y", "x", "t")


@query(f"with {FLASH}, n as (select floor(s / 259200)::bigint % 10 as t, y, x, count(*) as n from flash group by all) select t, y, x, case when t % 9 = 4 then -1 else coalesce(n, 0) end as n from (select i as t from range(10) r(i)) cross join (select i as y from range(20) r(i)) cross join (select i as x from range(64) r(i)) left join n using (t, y, x)")
def flash_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts on a full grid, -1 at steps without observations."""
    flash, _ = _flashes(spark, sf_dir)
    grid = spark.range(10 * 20 * 64).select(F.floor(F.col("id") / 1280).alias("t"), (F.floor(F.col("id") / 64) % 20).alias("y"), (F.col("id") % 64).alias("x"))
    covered = spark.range(10).where("id % 9 <> 4").select(F.col("id").alias("t"))
    return regrid.counted(flash.withColumn("t", F.floor(F.col("s") / 259200) % 10), grid, covered)


@query("""with k as (select ceil(max(l_extendedprice) / 2500)::bigint as k from lineitem), r as (select k, unnest(range(k + 1)) as i from k),
e as (select i, k, case when i = 0 then 0.0 else i * 2500.0 - 1250 end as lo, case when i = k then k * 2500.0 else i * 2500.0 + 1250 end as hi from r)
select e.i as bin, count(*) as n from lineitem l join e on l_extendedprice >= lo and (l_extendedprice < hi or (i = k and l_extendedprice = hi)) group by e.i""")
def bin_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points counted in bins around coordinates that span the table, half-width at the ends."""
    li = fx.table(spark, sf_dir, "lineitem")
    last = li.agg(F.ceil(F.max("l_extendedprice") / 2500).alias("k"))
    grid = regrid.edges(last.select(F.explode(F.sequence(F.lit(0).cast("long"), "k")).alias("id")).select((F.col("id") * 2500.0).alias("c")))
    return regrid.binned(li, grid, "l_extendedprice", "bin").groupBy(F.col("bin").cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("""with g as (select l_suppkey % 7 as t, l_suppkey % 20 as y, l_partkey % 64 as x, l_extendedprice / 5 as alt, case when l_returnflag <> 'N' then l_quantity end as ref from lineitem),
l as (select t, y, x, floor((alt - 2500) / 500) as layer, count(*) as raw, count(ref) as valid, sum(ref) as s from g where alt > 2500 and alt < 10000 group by all)
select t, y, x, sum(raw)::bigint as raw, sum(valid)::bigint as valid, round(sum(s) / nullif(sum(valid), 0), 6) as mean, round(max(s / nullif(valid, 0)), 6) as max from l group by t, y, x""")
def radar_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates on cells and layers of height."""
    li = fx.table(spark, sf_dir, "lineitem")
    gates = li.select((F.col("l_suppkey") % 7).alias("t"), (F.col("l_suppkey") % 20).alias("y"), (F.col("l_partkey") % 64).alias("x"), (F.col("l_extendedprice") / 5).alias("alt"), F.when(F.col("l_returnflag") != "N", F.col("l_quantity")).alias("ref"))
    return r6(regrid.layered(gates))


@query("""with g as (select l_suppkey % 7 as t, l_suppkey % 20 as y, l_partkey % 64 as x, l_linenumber as site, count(*) as raw, count(case when l_returnflag <> 'N' then 1 end) as valid, avg(case when l_returnflag <> 'N' then l_quantity end) as mean from lineitem group by all)
select t, y, x, round(coalesce(sum(mean * valid) / nullif(sum(valid), 0), -33), 6) as ref from g group by t, y, x""")
def radar_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites combined; scanned cells without echo at the floor."""
    li = fx.table(spark, sf_dir, "lineitem")
    ref = F.when(F.col("l_returnflag") != "N", F.col("l_quantity"))
    cells = li.groupBy((F.col("l_suppkey") % 7).alias("t"), (F.col("l_suppkey") % 20).alias("y"), (F.col("l_partkey") % 64).alias("x"), "l_linenumber").agg(F.count(F.lit(1)).alias("raw"), F.count(ref).alias("valid"), F.avg(ref).alias("mean"))
    return r6(regrid.combined_sites(cells))


@query(f"with {PLACES} select least(floor(lat), 89)::bigint as lat, least(floor(lon), 179)::bigint as lon, count(*) as n from places group by 1, 2")
def degree_climatology(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat, lon = regrid.degree_bins(F.col("lat"), F.col("lon"))
    return _places(spark, sf_dir).groupBy(lat.alias("lat"), lon.alias("lon")).agg(F.count(F.lit(1)).alias("n"))


def _rare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.cube(spark, sf_dir).select("t", "y", "x", F.when(F.col("v") > 0.4, 1 + F.floor(F.col("x") / 8)).otherwise(0).cast("int").alias("label"))


RARE = fx.CUBE + ", rare as (select t, y, x, case when v > 0.4 then 1 + x // 8 else 0 end::int as label from cube), m as (select * from rare where label <> 0)"
CYLINDER = "cyl as (select c.t, c.y, c.x, min(sqrt((c.y - m.y) ** 2 + (c.x - m.x) ** 2)) as v from cube c left join m on abs(m.t - c.t) <= 1 group by c.t, c.y, c.x)"


@query(f"with {RARE}, {CYLINDER} select t, y, x, round(v, 6) as v from cyl")
def cylinder_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(validation.cylinder_distance(_rare(spark, sf_dir), 1))


EVENTS = "ev as (select (event_id % 25)::int as t, (user_id % 20)::int as y, (event_id * 7 % 64)::int as x, count(*) as n from events where event_type = 'error' group by all)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.table(spark, sf_dir, "events").where("event_type = 'error'")
    return e.groupBy((F.col("event_id") % 25).cast("int").alias("t"), (F.col("user_id") % 20).cast("int").alias("y"), (F.col("event_id") * 7 % 64).cast("int").alias("x")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {RARE}, {CYLINDER}, {EVENTS}, i as (select t, y, x, y between 3 and 16 and x between 3 and 60 and t between 1 and (select max(t) from cube) - 1 as inside from cube),
d as (select c.t, c.y, c.x, min(sqrt((c.y - e.y) ** 2 + (c.x - e.x) ** 2)) as d from cube c left join ev e on abs(e.t - c.t) <= 1 group by c.t, c.y, c.x),
p as (select sum(case when v <= 6 then n else 0 end) / sum(n) as pod, sum(n)::bigint as n_events from ev join i using (t, y, x) join cyl using (t, y, x) where inside),
o as (select label, min(d) as dist, bool_and(inside) as ok from m join i using (t, y, x) join d using (t, y, x) group by label),
f as (select avg(case when ok then coalesce(dist > 6, true)::int end) as far, count(*) filter (ok) as n_objects from o)
select round(pod, 6) as pod, n_events, round(far, 6) as far, n_objects, round(2 * pod * (1 - far) / nullif(pod + 1 - far, 0), 6) as f1 from p, f""")
def pod_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of events that objects explain, share of objects without events, and their harmonic mean."""
    rare, ev = _rare(spark, sf_dir), _events(spark, sf_dir)
    grid = fx.cube(spark, sf_dir).select("t", "y", "x")
    on_grid = grid.join(ev, ["t", "y", "x"], "left").select("t", "y", "x", F.coalesce("n", F.lit(0)).alias("label"))
    inside = validation.edge_filter(grid, 3, 1)
    return r6(validation.validate(rare, ev, validation.cylinder_distance(rare, 1), validation.cylinder_distance(on_grid, 1), inside, 6.0)[1])


@query(f"with {RARE}, {CYLINDER}, n as (select count(v) as n from cyl) select least(floor(v), 39)::bigint as bin, round(count(*) / any_value(n.n), 9) as share from cyl, n where v between 0 and 40 group by 1")
def distance_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = validation.distance_histogram(validation.cylinder_distance(_rare(spark, sf_dir), 1), "v")
    return h.withColumn("share", F.round("share", 9))


@query("""with f as (select page_id, 'OR_ABI-L2-MCMIPC-M6_G16_s2018' || lpad((1 + page_id % 365)::varchar, 3, '0') || lpad((page_id % 24)::varchar, 2, '0') || '01125_e2018' || lpad((1 + page_id % 365)::varchar, 3, '0') || lpad((page_id % 24)::varchar, 2, '0') || '03509_c.nc' as name from pages)
select page_id, name, (timestamp '2018-01-01' + to_days((page_id % 365)::int) + to_hours(page_id % 24) + to_microseconds(151700000))::timestamp as t from f where page_id % 10 <> 3""")
def file_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times in names of files, without the files known to be corrupt."""
    k = F.col("page_id")
    stamp = F.concat(F.lpad((1 + k % 365).cast("string"), 3, "0"), F.lpad((k % 24).cast("string"), 2, "0"))
    name = F.concat(F.lit("OR_ABI-L2-MCMIPC-M6_G16_s2018"), stamp, F.lit("01125_e2018"), stamp, F.lit("03509_c.nc"))
    f = fx.table(spark, sf_dir, "pages").select("page_id", name.alias("name"))
    corrupt = f.where("page_id % 10 = 3").select("name")
    return files.without(f, corrupt).select("page_id", "name", files.goes_time(F.col("name")).cast("timestamp_ntz").alias("t"))


@query(f"""with {fx.CUBE}, grid as (select distinct y, x, 20 + y / 4.0 as lat, -90 + x / 4.0 as lon from cube), {_vincenty("""points as (select [a.y, a.x, 0] as k, a.lat as lat1, a.lon as lon1, b.lat as lat2, b.lon as lon2 from grid a join grid b on b.y = a.y and b.x = a.x + 1
 union all select [a.y, a.x, 1], a.lat, a.lon, b.lat, b.lon from grid a join grid b on b.y = a.y + 1 and b.x = a.x)""")},
s as (select k[1] as y, k[2] as x, k[3] as axis, km from geodesic), ends as (select y, x, axis, km from s union all select case axis when 1 then y + 1 else y end, case axis when 0 then x + 1 else x end, axis, km from s),
m as (select y, x, avg(km) filter (axis = 0) as dx, avg(km) filter (axis = 1) as dy from ends group by y, x) select y, x, round(dx, 6) as dx, round(dy, 6) as dy, round(dx * dy, 6) as area from m""")
def pixel_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spacing and area of a regular grid of a quarter of a degree."""
    grid = fx.cube(spark, sf_dir).select("y", "x").distinct().select("y", "x", (20 + F.col("y") / 4).alias("lat"), (-90 + F.col("x") / 4).alias("lon"))
    return r6(geo.pixel_spacing(grid))


VIEW = f"""{PLACES}, e as (select k, radians(lat) as p, radians(lon) as q, {A!r} / sqrt(1 - {1 - B * B / (A * A)!r} * sin(radians(lat)) ** 2) as n from places),
v as (select k, cos(p) * cos(q) as nx, cos(p) * sin(q) as ny, sin(p) as nz, {A + geo.SATELLITE_HEIGHT!r} * cos(radians(-75)) - n * cos(p) * cos(q) as vx, {A + geo.SATELLITE_HEIGHT!r} * sin(radians(-75)) - n * cos(p) * sin(q) as vy, -n * {B * B / (A * A)!r} * sin(p) as vz from e)"""


@query(f"with {VIEW} select k, round(degrees(acos((nx * vx + ny * vy + nz * vz) / sqrt(vx * vx + vy * vy + vz * vz))), 6) as zenith from v")
def view_zenith(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(_places(spark, sf_dir).select("k", geo.view_zenith(F.col("lat"), F.col("lon")).alias("zenith")))


@query(f"with {PLACES} select k, round(lat + degrees(9000 / 6371000.0) * tan(radians(lat)), 6) as lat, round(lon + degrees(9000 / 6371000.0) * tan(radians(lon + 75)), 6) as lon from places where abs(lon + 75) < 60")
def radar_parallax(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _places(spark, sf_dir).where("abs(lon + 75) < 60")
    lat, lon = geo.radar_parallax(F.col("lat"), F.col("lon"), F.lit(9000.0))
    return r6(p.select("k", lat.alias("lat"), lon.alias("lon")))


@query(f"""with {RARE}, d as (select c.t, c.y, c.x, min(sqrt((c.y - r.y) ** 2 + (c.x - r.x) ** 2 + ((c.t - r.t) * 2.0) ** 2)) as v from cube c left join rare r on r.label <> 0 group by c.t, c.y, c.x)
select t, y, x, round(v, 6) as v from d""")
def ellipse_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance to the nearest marker of any step, a step counting as two pixels."""
    return r6(validation.ellipse_distance(_rare(spark, sf_dir), 3, 6).drop("nearest"))


@query(f"""with {fx.CUBE}, m as (select t, y, x from cube where v > 0.35), k as (select distinct c.t, c.y, c.x from cube c join m on abs(c.t - m.t) <= 1 and (c.y - m.y) ** 2 + (c.x - m.x) ** 2 < 9),
g as (select t from (select t, 600 * t + case when t > 10 then 3600 else 0 end as s from (select distinct t from cube)) qualify lead(s) over (order by t) - s > 900),
l as (select distinct unnest([t, t + 1, t + 2]) as t from g)
select t, y, x, y between 3 and 16 and x between 3 and 60 and t between 1 and (select max(t) from cube) - 1 and (t, y, x) not in (select (t, y, x) from k) and t not in (select t from l) as inside from cube""")
def edge_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels away from the border, from missing ones and from a gap in time."""
    c = fx.cube(spark, sf_dir)
    times = c.select("t").distinct().select("t", (600 * F.col("t") + F.when(F.col("t") > 10, 3600).otherwise(0)).alias("seconds"))
    return validation.edge_filter(c, 3, 1, F.col("v") > 0.35, times)


@query(f"""with {RARE}, {fx.LABEL.removeprefix(fx.CUBE + ", ")}, {EVENTS}, idx as (select r.label as core, max(case when l.label % 2 = 0 then l.label else 0 end) as anvil from rare r join label l using (t, y, x) where r.label <> 0 group by 1),
k as (select unnest(['core', 'core_with_anvil', 'anvil', 'anvil_with_core']) as kind),
mk as (select 'core' as kind, t, y, x, label from m union all select 'anvil', t, y, x, label from label where label <> 0 union all select 'core_with_anvil', t, y, x, label from m where label in (select core from idx where anvil <> 0)
 union all select 'anvil_with_core', t, y, x, label from label where label in (select anvil from idx where anvil <> 0)),
i as (select t, y, x, y between 3 and 16 and x between 3 and 60 and t between 1 and (select max(t) from cube) - 1 as inside from cube),
pe as (select k.kind, e.t, e.y, e.x, any_value(n) as n, min(sqrt((e.y - mk.y) ** 2 + (e.x - mk.x) ** 2)) as v from ev e join i using (t, y, x) cross join k left join mk on mk.kind = k.kind and abs(mk.t - e.t) <= 1 where inside group by all),
p as (select kind, sum(case when v <= 6 then n else 0 end) / sum(n) as pod, sum(n)::bigint as n_events from pe group by kind),
d as (select mk.kind, mk.label, mk.t, mk.y, mk.x, min(sqrt((e.y - mk.y) ** 2 + (e.x - mk.x) ** 2)) as d from mk left join ev e on abs(e.t - mk.t) <= 1 group by all),
o as (select kind, label, min(d) as dist, bool_and(inside) as ok from d join i using (t, y, x) group by kind, label),
f as (select kind, avg(case when ok then coalesce(dist > 6, true)::int end) as far, count(*) filter (ok) as n_objects from o group by kind)
select kind, round(pod, 6) as pod, n_events, round(far, 6) as far, coalesce(n_objects, 0) as n_objects, round(2 * pod * (1 - far) / nullif(pod + 1 - far, 0), 6) as f1 from p left join f using (kind)""")
def validation_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detection and false alarms of cores, of anvils, and of those that have each other."""
    cores, ev = _rare(spark, sf_dir), _events(spark, sf_dir)
    anvils = fx.label(spark, sf_dir).select("t", "y", "x", "label")
    index = cores.where("label <> 0").join(anvils.select("t", "y", "x", F.col("label").alias("anvil")), ["t", "y", "x"]).groupBy(F.col("label").alias("core")).agg(F.max(F.when(F.col("anvil") % 2 == 0, F.col("anvil")).otherwise(0)).alias("anvil"))
    both = validation.with_partners(cores, anvils, index)
    grid = fx.cube(spark, sf_dir).select("t", "y", "x")
    kinds = {"core": cores, "core_with_anvil": both[0], "anvil": anvils, "anvil_with_core": both[1]}
    return r6(validation.validate_all(kinds, ev, grid, validation.edge_filter(grid, 3, 1), 6.0, 1)[1])
