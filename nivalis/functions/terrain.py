"""Terrain classes and exposures as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nivalis.functions.geo import coast_km

#: Fixed values: (name, from, below).
ELEVATION_BANDS = [("low", 0.0, 2000.0), ("mid", 2000.0, 2500.0), ("high", 2500.0, 3000.0), ("alpine", 3000.0, float("inf"))]
SLOPE_CLASSES = [("flat", 0.0, 5.0), ("gentle", 5.0, 15.0), ("moderate", 15.0, 30.0), ("steep", 30.0, 45.0), ("extreme", 45.0, float("inf"))]
CARDINALS = ["N", "NE", "E", "SE", "S", "SW", "W", "NW"]


def classed(x: Column, classes: list[tuple[str, float, float]], missing: str = "unknown") -> Column:
    """The class that holds x; what none holds is in the last."""
    out = F.when(x.isNull(), missing)
    for name, low, high in classes:
        out = out.when((x >= low) & (x < high), name)
    return out.otherwise(classes[-1][0])


def elevation_band(m: Column) -> Column:
    return classed(m, ELEVATION_BANDS)


def slope_category(deg: Column) -> Column:
    return classed(deg, SLOPE_CLASSES)


def cardinal(aspect: Column) -> Column:
    """Eight-way direction."""
    eighth = F.pmod(F.floor((F.pmod(aspect, F.lit(360.0)) + 22.5) / 45), F.lit(8)).cast("int") + 1
    return F.when(aspect.isNull(), "unknown").otherwise(F.element_at(F.array(*map(F.lit, CARDINALS)), eighth))


def north_facing(aspect: Column) -> Column:
    a = F.pmod(aspect, F.lit(360.0))
    return F.coalesce(((a >= 315) | (a <= 45)).cast("int"), F.lit(0))


def solar_exposure(aspect: Column, slope: Column) -> Column:
    """1 on a steep south face, 0 on a steep north face, 0.5 where flat or unknown."""
    toward_south = -F.cos(F.radians(aspect))
    return F.coalesce(0.5 + 0.5 * toward_south * F.least(slope / 45.0, F.lit(1.0)), F.lit(0.5))


def wind_exposure(tpi: Column) -> Column:
    return F.when(tpi.isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 + tpi / 100.0)))


def latitude_normalized(lat: Column) -> Column:
    return F.when(lat.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (lat - 31.0) / 18.0)))


def all_features(df: DataFrame) -> DataFrame:
    """All terrain features whose inputs `df` has, in one select."""
    c, have, out = F.col, set(df.columns), {}
    if "elevation" in have:
        out |= {"elevation_km": c("elevation") / 1000.0, "elevation_band": elevation_band(c("elevation"))}
    if "slope" in have:
        out["slope_category"] = slope_category(c("slope"))
    if "aspect" in have:
        a = F.radians(c("aspect"))
        out |= {"aspect_sin": F.sin(a), "aspect_cos": F.cos(a), "aspect_cardinal": cardinal(c("aspect")), "is_north_facing": north_facing(c("aspect"))}
    if {"aspect", "slope"} <= have:
        out["solar_exposure"] = solar_exposure(c("aspect"), c("slope"))
    if "tpi" in have:
        out["wind_exposure"] = wind_exposure(c("tpi"))
    if "roughness" in have:
        out["terrain_roughness"] = c("roughness")
    if "lat" in have:
        out["latitude_normalized"] = latitude_normalized(c("lat"))
    if {"lat", "lon"} <= have:
        out["distance_to_coast_km"] = coast_km(c("lat"), c("lon"))
    return df.select("*", *[x.alias(n) for n, x in out.items()])
