"""Calibrated quantities and composites of imager channels, and cloud radiative effects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftframe.functions.normalise import clamp


def checked(value: Column, flag: Column | None) -> Column:
    """NULL where the quality flag is below 0 or over 1."""
    return value if flag is None else F.when((flag >= 0) & (flag <= 1), value)


def reflectance(rad: Column, kappa0: Column, flag: Column | None = None) -> Column:
    return checked(rad * kappa0, flag)


def brightness_temperature(rad: Column, fk1: Column, fk2: Column, bc1: Column, bc2: Column, flag: Column | None = None) -> Column:
    """Inverse of Planck's law with the channel's coefficients."""
    return checked((fk2 / F.log(fk1 / F.nullif(rad, F.lit(0.0)) + 1) - bc1) / bc2, flag)


def calibrated(band: Column, rad: Column, kappa0: Column, fk1: Column, fk2: Column, bc1: Column, bc2: Column, flag: Column | None = None) -> Column:
    """Reflectance of the first six bands, brightness temperature of the others."""
    return F.when(band < 7, reflectance(rad, kappa0, flag)).otherwise(brightness_temperature(rad, fk1, fk2, bc1, bc2, flag))


def contrast(v: Column, amount: float) -> Column:
    f = 259 * (amount + 255) / (255 * 259 - amount)
    return clamp(f * (v - 0.5) + 0.5, 0.0, 1.0)


def channel_range(v: Column, low: float = 0.0, high: float = 1.0, gamma: float = 1.0, clamped: bool = False) -> Column:
    """(v - low) / (high - low) ** gamma up to ``high``; ``clamped`` also at ``low``."""
    top = F.when(v.isNotNull(), F.least(v, F.lit(high)))
    if clamped:
        top = F.when(v.isNotNull(), F.greatest(top, F.lit(low)))
    return (top - low) / (high - low) ** gamma


def true_colour(c01: Column, c02: Column, c03: Column, gamma: float = 0.4, amount: float = 100.0, cos_zenith: Column | None = None, min_cos: float = 0.05, night: Column | None = None) -> Column:
    """struct(r, g, b): green from red, near infrared and blue; optionally over the cosine of the sun's zenith, and
    with infrared where that is brighter."""
    parts = []
    for v in (c02, c03, c01):
        if cos_zenith is not None:
            v = v / F.greatest(cos_zenith, F.lit(min_cos))
        parts.append(F.pow(clamp(v, 0.0, 1.0), F.lit(gamma)))
    red, veggie, blue = parts
    green = clamp(0.48358168 * red + 0.45706946 * blue + 0.06038137 * veggie, 0.0, 1.0)
    rgb = [contrast(v, amount) for v in (red, green, blue)]
    if night is not None:
        ir = (1 - clamp((night - 90) / (313 - 90), 0.0, 1.0)) / 1.5
        rgb = [F.greatest(v, ir) for v in rgb]
    return F.struct(*(v.alias(n) for v, n in zip(rgb, "rgb", strict=True)))


def deep_cloud(c02: Column, c08: Column, c13: Column, cos_zenith: Column, min_cos: float = 0.05) -> Column:
    """struct(r, g, b): water vapour against window, visible, window temperature."""
    red = channel_range(c08 - c13, -35.0, 5.0, clamped=True)
    green = channel_range(c02 / F.greatest(cos_zenith, F.lit(min_cos)), 0.7, 1.0, clamped=True)
    blue = channel_range(c13, 243.6, 292.6, clamped=True)
    return F.struct(red.alias("r"), green.alias("g"), (1 - blue).alias("b"))


FLUXES = ("toa_swup", "toa_lwup", "boa_swup", "boa_swdn", "boa_lwup", "boa_lwdn")


def add_effects(df: DataFrame, sign: int = 1) -> DataFrame:
    """``{flux}_cre`` (flux less ``{flux}_clr``, times ``sign``) of each flux there is, and the net ones."""
    have = [c for c in FLUXES if {c, f"{c}_clr"} <= set(df.columns)]
    df = df.withColumns({f"{c}_cre": sign * (F.col(c) - F.col(f"{c}_clr")) for c in have})
    if {"toa_swup", "toa_lwup"} <= set(have):
        df = df.withColumns({"toa_net_cre": -(F.col("toa_swup_cre") + F.col("toa_lwup_cre"))})
        if "toa_swdn" in df.columns:
            df = df.withColumn("toa_net", F.col("toa_swdn") - F.col("toa_swup") - F.col("toa_lwup"))
    if {"boa_swup", "boa_swdn", "boa_lwup", "boa_lwdn"} <= set(have):
        net = lambda s: F.col(f"boa_swdn{s}") + F.col(f"boa_lwdn{s}") - F.col(f"boa_swup{s}") - F.col(f"boa_lwup{s}")
        df = df.withColumns({"boa_net": net(""), "boa_net_cre": net("_cre")})
    return df
