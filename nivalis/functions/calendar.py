"""Calendar features of a timestamp or date column, and zones."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def cyclic(value: Column, period: float) -> tuple[Column, Column]:
    """Sine and cosine of a place in a cycle."""
    angle = value * (2 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def season(ts: Column) -> Column:
    m = F.month(ts)
    return F.when(m.isin(12, 1, 2), "winter").when(m.isin(3, 4, 5), "spring").when(m.isin(6, 7, 8), "summer").when(m.isNotNull(), "fall")


def water_year(ts: Column) -> Column:
    """The year that began on 1 October before."""
    return F.year(ts) + (F.month(ts) >= 10).cast("int")


def water_day(ts: Column) -> Column:
    return F.date_diff(ts.cast("date"), F.make_date(water_year(ts) - 1, F.lit(10), F.lit(1))) + 1


def all_features(df: DataFrame, ts: str = "datetime") -> DataFrame:
    """All calendar features, in one select (F10-F15). A string column is read as a timestamp."""
    t = F.to_timestamp(F.col(ts)) if dict(df.dtypes)[ts] == "string" else F.col(ts)
    day, month = F.dayofyear(t), F.month(t)
    day_sin, day_cos = cyclic(day, 365.25)
    month_sin, month_cos = cyclic(month, 12)
    weekday = F.weekday(t)
    out = {
        "day_of_year": day, "day_of_year_sin": day_sin, "day_of_year_cos": day_cos, "month": month, "month_sin": month_sin, "month_cos": month_cos,
        "season": season(t), "is_winter": month.isin(12, 1, 2).cast("int"), "is_snow_season": month.isin(11, 12, 1, 2, 3, 4).cast("int"),
        "day_of_week": weekday, "is_weekend": (weekday >= 5).cast("int"), "week_of_year": F.weekofyear(t),
        "water_year": water_year(t), "day_of_water_year": water_day(t), "water_year_progress": F.greatest(F.lit(0.0), F.least(F.lit(1.0), (water_day(t) - 1) / 365.25)),
    }
    return df.select("*", *[x.alias(n) for n, x in out.items() if n not in df.columns])


def to_utc(ts: Column, zone: str | None = None) -> Column:
    """Local times of `zone` as UTC; without a zone they are taken for UTC (F16)."""
    return F.to_utc_timestamp(ts, zone) if zone else ts


def dates(spark: SparkSession, start: str, end: str, step: str = "1 day") -> DataFrame:
    """One row per date, both ends included."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr(f"interval {step}"))).alias("date"))
