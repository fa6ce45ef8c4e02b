"""Atmospheric functions of columns. Missing stays NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KELVIN = 273.15
MAGNUS_A, MAGNUS_B = 17.625, 243.04


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def celsius(k: Column) -> Column:
    return k - KELVIN


def below_freezing(k: Column) -> Column:
    return (celsius(k) < 0).cast("int")


def relative_humidity(t_c: Column, dew_c: Column) -> Column:
    """Magnus formula, in percent."""
    vapour = lambda t: F.exp(MAGNUS_A * t / (MAGNUS_B + t))
    return clip(100 * vapour(dew_c) / vapour(t_c), 0.0, 100.0)


def wet_bulb(t_c: Column, rh: Column) -> Column:
    """Stull's formula."""
    return t_c * F.atan(0.151977 * F.sqrt(rh + 8.313659)) + F.atan(t_c + rh) - F.atan(rh - 1.676331) + 0.00391838 * F.pow(rh, 1.5) * F.atan(0.023101 * rh) - 4.686035


def wind_speed(u: Column, v: Column) -> Column:
    return F.sqrt(u * u + v * v)


def wind_direction(u: Column, v: Column) -> Column:
    """Where the wind comes from, in degrees; 0 in calm air."""
    return F.when(wind_speed(u, v) > 0.1, F.pmod(270 - F.degrees(F.atan2(v, u)), F.lit(360.0))).when(u.isNotNull() & v.isNotNull(), 0.0)


def wind_chill(t_c: Column, speed: Column) -> Column:
    """North American formula where it holds, else the temperature."""
    kmh = speed * 3.6
    p = F.pow(kmh, 0.16)
    return F.when((t_c <= 10) & (kmh >= 4.8), 13.12 + 0.6215 * t_c - 11.37 * p + 0.3965 * t_c * p).otherwise(t_c)


def snow_fraction(snow: Column, total: Column) -> Column:
    return F.when(total > 0, clip(snow / total, 0.0, 1.0)).when(total.isNotNull(), 0.0)


def all_features(df: DataFrame) -> DataFrame:
    """All atmospheric features whose inputs `df` has, in one select (F9): t2m, d2m (K), u10, v10 (m/s), sp (Pa), tp, sf, sd (m)."""
    c, have = F.col, set(df.columns)
    out: dict[str, Column] = {}
    if "t2m" in have:
        out |= {"t2m_celsius": celsius(c("t2m")), "is_below_freezing": below_freezing(c("t2m"))}
    if {"t2m", "d2m"} <= have:
        t, d = celsius(c("t2m")), celsius(c("d2m"))
        rh = relative_humidity(t, d)
        out |= {"relative_humidity": rh, "dewpoint_depression": t - d, "wet_bulb_temp": wet_bulb(t, rh)}
    if {"u10", "v10"} <= have:
        speed = wind_speed(c("u10"), c("v10"))
        out |= {"wind_speed": speed, "wind_direction": wind_direction(c("u10"), c("v10"))}
        if "t2m" in have:
            out["wind_chill"] = wind_chill(celsius(c("t2m")), speed)
    if "sp" in have:
        out["pressure_hpa"] = c("sp") / 100
    for source, name in (("tp", "precip_mm"), ("sf", "snowfall_mm"), ("sd", "snow_depth_mm")):
        if source in have:
            out[name] = c(source) * 1000
    if {"tp", "sf"} <= have:
        out["snow_fraction"] = snow_fraction(c("sf"), c("tp"))
    return df.select("*", *[x.alias(n) for n, x in out.items()])
