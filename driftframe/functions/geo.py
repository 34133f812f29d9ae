"""Distances, azimuths and solar and satellite angles, as column expressions in degrees and km."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Mean radius of the Earth in km, for spherical distances.
RADIUS = 6371.0


def great_circle(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Spherical distance in km."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * RADIUS * F.asin(F.sqrt(F.when(h > 1, F.lit(1.0)).otherwise(h)))


def azimuth(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Direction of the second point from the first, clockwise from north, in [-180, 180]; NULL for equal points."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2) - F.radians(lon1)
    x, y = F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)
    return F.when((lat1 != lat2) | (lon1 != lon2), F.degrees(F.atan2(x, y)))


#: Fourier coefficients (constant, then cosine and sine of each harmonic) of the declination in radians and
#: of the equation of time in hours.
DECLINATION = (0.006918, -0.399912, 0.070257, -0.006758, 0.000907, -0.002697, 0.001480)
EQUATION_OF_TIME = (0.0, 0.0072, -0.1229, -0.0528, -0.1565, -0.0012, -0.0041)


def _series(a: Column, terms: tuple[float, ...]) -> Column:
    out = F.lit(terms[0])
    for k in range(1, (len(terms) + 1) // 2):
        out = out + terms[2 * k - 1] * F.cos(k * a) + terms[2 * k] * F.sin(k * a)
    return out


def solar_angles(ts: Column, lat: Column, lon: Column, day_ahead: bool = False, full_circle: bool = False) -> tuple[Column, Column]:
    """Zenith and azimuth of the sun in degrees. Whole days count from 1, from 2 if ``day_ahead``. The azimuth is the
    angle from north to either side, from 0 to 180; with ``full_circle`` it goes clockwise up to 360."""
    day = (F.dayofyear(ts) + (1 if day_ahead else 0)).cast("double")
    dec, eqt = _series(2 * F.pi() * day / 365.0, DECLINATION), _series(2 * F.pi() * day / 366.0, EQUATION_OF_TIME)
    utc = F.hour(ts) + F.minute(ts) / 60.0 + (F.lit(0.0) if day_ahead else F.second(ts) / 3600.0)
    hour, p = F.radians(15.0 * (utc + lon / 15.0 + eqt - 12.0)), F.radians(lat)
    within = lambda c: F.least(F.greatest(c, F.lit(-1.0)), F.lit(1.0))
    height = F.asin(within(F.sin(dec) * F.sin(p) + F.cos(dec) * F.cos(p) * F.cos(hour)))
    north = F.sin(dec) * F.cos(p) - F.cos(dec) * F.sin(p) * F.cos(hour)
    if full_circle:
        return 90.0 - F.degrees(height), F.pmod(F.degrees(F.atan2(-F.cos(dec) * F.sin(hour), north)), F.lit(360.0))
    return 90.0 - F.degrees(height), F.degrees(F.acos(within(north / F.nullif(F.cos(height), F.lit(0.0)))))


def viewing_angles(lat: Column, lon: Column, sat_lat: float = 0.0, sat_lon: float = 0.0, altitude: float = 35793.0) -> tuple[Column, Column]:
    """Zenith (over 90 beyond the limb) and azimuth of a satellite in degrees, on a sphere."""
    p, q, d = F.radians(lat), F.radians(F.lit(sat_lat)), F.radians(lon - sat_lon)
    c = F.cos(p) * F.cos(q) * F.cos(d) + F.sin(p) * F.sin(q)
    ratio = RADIUS / (RADIUS + altitude)
    zenith = F.degrees(F.atan2(F.sqrt(1 - c * c), c - ratio))
    azi = F.atan2(-F.sin(d) * F.cos(q), F.sin(q) * F.cos(p) - F.cos(q) * F.sin(p) * F.cos(d))
    return zenith, F.pmod(F.degrees(azi), F.lit(360.0))


#: Semi-axes of WGS84 and GRS80, and of the ellipsoid of lightning, in m.
WGS84 = (6378137.0, 6356752.314245179)
GRS80 = (6378137.0, 6356752.31414)
LIGHTNING = (6378137.0 + 14000.0, 6362755.0)
SATELLITE_HEIGHT = 35786023.0


def inverse_flattening(major: float, minor: float) -> float:
    return major / (major - minor)


def to_ecef(lon: Column, lat: Column, alt: Column, axes: tuple[float, float] = WGS84) -> tuple[Column, Column, Column]:
    a, b = axes
    e2 = 1 - b * b / (a * a)
    p, q = F.radians(lat), F.radians(lon)
    n = a / F.sqrt(1 - e2 * F.sin(p) * F.sin(p))
    return (n + alt) * F.cos(p) * F.cos(q), (n + alt) * F.cos(p) * F.sin(q), (n * (b * b / (a * a)) + alt) * F.sin(p)


def from_ecef(x: Column, y: Column, z: Column, axes: tuple[float, float] = WGS84) -> tuple[Column, Column, Column]:
    """Longitude, latitude and altitude by Bowring's formula."""
    a, b = axes
    e2, e3 = 1 - b * b / (a * a), a * a / (b * b) - 1
    r = F.hypot(x, y)
    t = F.atan2(z * a, r * b)
    lat = F.atan2(z + e3 * b * F.pow(F.sin(t), 3), r - e2 * a * F.pow(F.cos(t), 3))
    n = a / F.sqrt(1 - e2 * F.sin(lat) * F.sin(lat))
    alt = F.when(F.abs(F.cos(lat)) > 1e-9, r / F.cos(lat) - n).otherwise(F.abs(z) - b)
    return F.degrees(F.atan2(y, x)), F.degrees(lat), alt


def geos_forward(lat: Column, lon: Column, sat_lon: float = -75.0, height: float = SATELLITE_HEIGHT, axes: tuple[float, float] = GRS80) -> tuple[Column, Column]:
    """Scan angles (x, y) in radians of the fixed grid of a satellite that sweeps about x; NULL beyond the limb."""
    a, b = axes
    h = a + height
    p = F.atan(F.tan(F.radians(lat)) * (b * b / (a * a)))
    d = F.radians(lon - sat_lon)
    r = b / F.sqrt(1 - (1 - b * b / (a * a)) * F.cos(p) * F.cos(p))
    sx, sy, sz = h - r * F.cos(p) * F.cos(d), -r * F.cos(p) * F.sin(d), r * F.sin(p)
    seen = h * (h - sx) >= sy * sy + (a * a / (b * b)) * sz * sz
    return F.when(seen, F.asin(-sy / F.sqrt(sx * sx + sy * sy + sz * sz))), F.when(seen, F.atan(sz / sx))


def geos_inverse(x: Column, y: Column, sat_lon: float = -75.0, height: float = SATELLITE_HEIGHT, axes: tuple[float, float] = GRS80) -> tuple[Column, Column]:
    """Latitude and longitude of scan angles; NULL off the disc."""
    a, b = axes
    h = a + height
    k = a * a / (b * b)
    aa = F.sin(x) * F.sin(x) + F.cos(x) * F.cos(x) * (F.cos(y) * F.cos(y) + k * F.sin(y) * F.sin(y))
    bb, cc = -2 * h * F.cos(x) * F.cos(y), h * h - a * a
    disc = bb * bb - 4 * aa * cc
    rs = (-bb - F.sqrt(F.greatest(disc, F.lit(0.0)))) / (2 * aa)
    sx, sy, sz = rs * F.cos(x) * F.cos(y), -rs * F.sin(x), rs * F.cos(x) * F.sin(y)
    lat = F.degrees(F.atan(k * sz / F.sqrt((h - sx) * (h - sx) + sy * sy)))
    return F.when(disc >= 0, lat), F.when(disc >= 0, sat_lon - F.degrees(F.atan(sy / (h - sx))))


def parallax_offsets(lon: Column, lat: Column, sat_lon: float = -75.0) -> tuple[Column, Column]:
    """How far (lon, lat) of a flash on the ellipsoid of lightning lies from where the grid shows it."""
    x, y = geos_forward(lat, lon, sat_lon, axes=LIGHTNING)
    seen_lat, seen_lon = geos_inverse(x, y, sat_lon)
    return lon - seen_lon, lat - seen_lat


def geodesic(lat1: Column, lon1: Column, lat2: Column, lon2: Column, axes: tuple[float, float] = WGS84, steps: int = 8) -> Column:
    """Distance on the ellipsoid in km by Vincenty's iteration, unrolled; exact to mm but for nearly antipodal points."""
    a, b = axes
    f = (a - b) / a
    u1, u2 = F.atan((1 - f) * F.tan(F.radians(lat1))), F.atan((1 - f) * F.tan(F.radians(lat2)))
    big = F.radians(lon2) - F.radians(lon1)
    row = F.struct(F.sin(u1).alias("s1"), F.cos(u1).alias("c1"), F.sin(u2).alias("s2"), F.cos(u2).alias("c2"), big.alias("span"), big.alias("l"))

    def terms(r: Column) -> tuple[Column, ...]:
        ss = F.hypot(r["c2"] * F.sin(r["l"]), r["c1"] * r["s2"] - r["s1"] * r["c2"] * F.cos(r["l"]))
        cs = r["s1"] * r["s2"] + r["c1"] * r["c2"] * F.cos(r["l"])
        sa = F.when(ss > 0, r["c1"] * r["c2"] * F.sin(r["l"]) / ss).otherwise(0.0)
        c2 = 1 - sa * sa
        return ss, cs, sa, c2, F.when(c2 > 1e-15, cs - 2 * r["s1"] * r["s2"] / c2).otherwise(0.0)

    def turn(r: Column, _: Column) -> Column:
        ss, cs, sa, c2, cm = terms(r)
        c = f / 16 * c2 * (4 + f * (4 - 3 * c2))
        sigma = F.atan2(ss, cs)
        new = r["span"] + (1 - c) * f * sa * (sigma + c * ss * (cm + c * cs * (2 * cm * cm - 1)))
        return F.struct(r["s1"].alias("s1"), r["c1"].alias("c1"), r["s2"].alias("s2"), r["c2"].alias("c2"), r["span"].alias("span"), new.alias("l"))

    def length(r: Column) -> Column:
        ss, cs, _, c2, cm = terms(r)
        w = c2 * (a * a - b * b) / (b * b)
        p = 1 + w / 16384 * (4096 + w * (-768 + w * (320 - 175 * w)))
        q = w / 1024 * (256 + w * (-128 + w * (74 - 47 * w)))
        sigma = F.atan2(ss, cs)
        d = q * ss * (cm + q / 4 * (cs * (2 * cm * cm - 1) - q / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))
        return b * p * (sigma - d) / 1000

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), row, turn, length)


def pixel_spacing(grid: DataFrame) -> DataFrame:
    """``y, x, dx, dy, area`` in km: geodesic distances to both neighbours averaged, the only one at the borders."""
    out = grid
    for axis, across in (("x", "y"), ("y", "x")):
        w = Window.partitionBy(across).orderBy(axis)
        lat, lon = F.lead("lat").over(w), F.lead("lon").over(w)
        out = out.withColumns({"_lat": lat, "_lon": lon}).withColumn("_n", F.when(F.col("_lat").isNotNull(), geodesic(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon")))).drop("_lat", "_lon")
        before = F.lag("_n").over(w)
        out = out.withColumn(f"d{axis}", F.when(before.isNull(), F.col("_n")).when(F.col("_n").isNull(), before).otherwise((before + F.col("_n")) / 2)).drop("_n")
    return out.select("y", "x", "dx", "dy", (F.col("dx") * F.col("dy")).alias("area"))


def view_zenith(lat: Column, lon: Column, sat_lon: float = -75.0, height: float = SATELLITE_HEIGHT, axes: tuple[float, float] = GRS80) -> Column:
    """Angle in degrees between the surface's normal and the direction of the satellite, on the ellipsoid."""
    x, y, z = to_ecef(lon, lat, F.lit(0.0), axes)
    p, q = F.radians(lat), F.radians(lon)
    nx, ny, nz = F.cos(p) * F.cos(q), F.cos(p) * F.sin(q), F.sin(p)
    s = math.radians(sat_lon)
    vx, vy, vz = (axes[0] + height) * math.cos(s) - x, (axes[0] + height) * math.sin(s) - y, -z
    return F.degrees(F.acos((nx * vx + ny * vy + nz * vz) / F.sqrt(vx * vx + vy * vy + vz * vz)))


def radar_parallax(lat: Column, lon: Column, alt: Column, sat_lon: float = -75.0) -> tuple[Column, Column]:
    """Where a satellite over the equator sees an echo at height ``alt`` (m): shifted away from it by
    alt * tan(angle) / radius along each axis."""
    k = F.degrees(alt / (RADIUS * 1000))
    return lat + k * F.tan(F.radians(lat)), lon + k * F.tan(F.radians(lon - sat_lon))
