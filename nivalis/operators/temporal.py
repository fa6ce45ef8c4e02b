"""Resampling, calendars, coverage and merging of time series."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: How a day's value comes from its hours, by (part of) the column's name.
RULES = {
    "temp": "mean", "temperature": "mean", "temp_avg": "mean", "temp_avg_c": "mean", "temp_max": "max", "temp_min": "min", "tmax": "max", "tmin": "min",
    "precip": "sum", "precipitation": "sum", "prcp": "sum", "snowfall": "sum", "snow": "sum", "snowfall_cm": "sum",
    "snow_depth": "mean", "snow_depth_cm": "mean", "snwd": "mean", "swe": "mean", "swe_mm": "mean", "wind": "mean", "wind_speed": "mean", "wind_u": "mean", "wind_v": "mean",
    "humidity": "mean", "relative_humidity": "mean", "pressure": "mean", "surface_pressure": "mean",
}
AGGREGATES: dict[str, Callable[[str], Column]] = {"mean": F.avg, "sum": F.sum, "max": F.max, "min": F.min, "first": F.first, "last": F.last, "count": F.count}


def rule_for(name: str, rules: dict | None = None, pick: str = "longest") -> str | Callable:
    """The aggregate for a column (A2): the user's, else an exact name, else the longest (or first) part of it, else mean."""
    if rules and name in rules:
        return rules[name]
    low = name.lower()
    if pick == "longest" and low in RULES:
        return RULES[low]
    hits = [k for k in RULES if k in low]
    return RULES[max(hits, key=len) if pick == "longest" else hits[0]] if hits else "mean"


def calendar(df: DataFrame, group: list[str], day: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """All days of each group, from its first to its last or between given dates."""
    if start and end:
        days = df.select(*group).distinct().withColumn("_a", F.lit(start).cast("date")).withColumn("_b", F.lit(end).cast("date"))
    else:
        days = df.groupBy(*group).agg(F.min(day).alias("_a"), F.max(day).alias("_b"))
    return days.select(*group, F.explode(F.sequence("_a", "_b")).alias(day))


def resample_daily(df: DataFrame, ts: str, group: list[str] = (), rules: dict | None = None, values: list[str] | None = None, fill_bins: bool = False, pick: str = "longest") -> DataFrame:
    """Hourly to daily (A1). Missing hours are never made up. With `fill_bins`, days without rows have NULL, and sums 0."""
    group = list(group)
    values = values or [f.name for f in df.schema.fields if f.name not in (ts, *group) and f.dataType.typeName() in ("double", "float", "integer", "long")]
    chosen = {v: rule_for(v, rules, pick) for v in values}
    aggs = [(AGGREGATES[r] if isinstance(r, str) else r)(v).alias(v) for v, r in chosen.items()]
    out = df.withColumn("date", F.col(ts).cast("date")).groupBy(*group, "date").agg(*aggs)
    if fill_bins:
        out = calendar(out, group, "date").join(out, [*group, "date"], "left")
        out = out.select(*group, "date", *[F.coalesce(v, F.lit(0)).alias(v) if r == "sum" else F.col(v) for v, r in chosen.items()])
    return out


#: Seconds of units of fixed length, and months of the others.
SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}
MONTHS = {"month": 1, "quarter": 3, "year": 12, "water year": 12}
MONDAY = 4 * 86400  # 1970-01-05


def bin_start(ts: Column, freq: str) -> tuple[Column, str]:
    """(start of the bin that `ts` is in, length as an interval) for a frequency such as "6 hours", "month", "2 quarters" or "water year".

    Bins of fixed length are counted from 1970-01-01 (weeks from a Monday), months and quarters from January, water
    years from October."""
    found = re.fullmatch(r"(\d+)?\s*(" + "|".join([*SECONDS, *MONTHS]) + r")s?", freq.strip().lower())
    if not found or found[1] == "0":
        raise ValueError(f"no such frequency: {freq}")
    n, unit = int(found[1] or 1), found[2]
    if unit in SECONDS:
        length, zero = n * SECONDS[unit], MONDAY if unit == "week" else 0
        return F.timestamp_seconds(F.floor((F.unix_seconds(ts) - zero) / length) * length + zero), f"INTERVAL {length} SECONDS"
    months, shift = n * MONTHS[unit], 9 if unit == "water year" else 0
    at = F.floor((F.year(ts) * 12 + F.month(ts) - 1 - shift) / months) * months + shift
    return F.make_date(F.floor(at / 12).cast("int"), (F.pmod(at, F.lit(12)) + 1).cast("int"), F.lit(1)).cast("timestamp"), f"INTERVAL {months} MONTHS"


def resample(df: DataFrame, ts: str, freq: str, group: list[str] = (), rules: dict | None = None, values: list[str] | None = None, fill_bins: bool = True, pick: str = "longest", zone: str | None = None) -> DataFrame:
    """As `resample_daily`, to any frequency (A1): (group, start, values); `ts` becomes the bin's start.

    With `fill_bins` there are all bins between a group's first and last; those without rows have NULL, and sums and
    counts 0. With `zone` bins are of local time there, and `ts` is its clock: days of 23 and 25 hours are one bin each. Times are
    UTC. Rows without a time are left out; null groups are a group. An unknown frequency is an error."""
    group = list(group)
    values = values or [f.name for f in df.schema.fields if f.name not in (ts, *group) and f.dataType.typeName() in ("double", "float", "integer", "long")]
    chosen = {v: rule_for(v, rules, pick) for v in values}
    aggs = [(AGGREGATES[r] if isinstance(r, str) else r)(v).alias(v) for v, r in chosen.items()]
    time = F.col(ts).cast("timestamp")
    start, length = bin_start(F.from_utc_timestamp(time, zone) if zone else time, freq)
    out = df.filter(F.col(ts).isNotNull()).withColumn(ts, start).groupBy(*group, ts).agg(*aggs)
    if not fill_bins:
        return out
    bins = out.groupBy(*group).agg(F.min(ts).alias("_a"), F.max(ts).alias("_b")).filter("_a is not null")
    bins = bins.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.explode(F.sequence("_a", "_b", F.expr(length))).alias("_t"))
    same = F.col("_t") == F.col(ts)
    for i, g in enumerate(group):
        same &= F.col(f"_g{i}").eqNullSafe(F.col(g))
    filled = [F.coalesce(v, F.lit(0)).alias(v) if r in ("sum", "count") else F.col(v) for v, r in chosen.items()]
    return bins.join(out, same, "left").select(*[F.col(f"_g{i}").alias(g) for i, g in enumerate(group)], F.col("_t").alias(ts), *filled)


def grid_daily(df: DataFrame, sums: list[str], ts: str = "time", deaccumulate: bool = False) -> DataFrame:
    """Grid cells' days (A3): sums of `sums`, means of the rest. `deaccumulate`: `sums` are running totals within a day."""
    values = [c for c in df.columns if c not in (ts, "lat", "lon")]
    if deaccumulate:
        w = W.partitionBy("lat", "lon", F.col(ts).cast("date")).orderBy(ts)
        df = df.select(ts, "lat", "lon", *[(F.col(v) - F.coalesce(F.lag(v).over(w), F.lit(0))).alias(v) if v in sums else F.col(v) for v in values])
    return df.groupBy("lat", "lon", F.col(ts).cast("date").alias("date")).agg(*[(F.sum(v) if v in sums else F.avg(v)).alias(v) for v in values])


def align(df: DataFrame, date: str, start: str, end: str, group: list[str] = (), order: str | None = None) -> DataFrame:
    """Every group on every day of a range; gaps are NULL; of several rows of a day the first by `order` stays."""
    group = list(group)
    if order:
        w = W.partitionBy(*group, date).orderBy(order)
        df = df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    return calendar(df, group, date, start, end).join(df, [*group, date], "left") if group else df.sparkSession.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias(date)).join(df, date, "left")


def merge_sources(frames: dict[str, DataFrame], keys: list[str] = ("date",), start: str | None = None, end: str | None = None) -> DataFrame:
    """Full outer join of sources; columns that clash get the source's name as suffix."""
    keys = list(keys)
    seen: dict[str, int] = {}
    for d in frames.values():
        for c in d.columns:
            seen[c] = seen.get(c, 0) + 1
    named = [d.select(*keys, *[F.col(c).alias(f"{c}_{n}" if seen[c] > 1 else c) for c in d.columns if c not in keys]) for n, d in frames.items()]
    out = reduce(lambda a, b: a.join(b, keys, "full_outer"), named)
    return out.filter(F.col(keys[-1] if "date" not in keys else "date").between(start, end)) if start and end else out


def gaps(df: DataFrame, date: str, start: str, end: str, group: list[str]) -> DataFrame:
    """Runs of days without rows: (group, gap_start, gap_end, days)."""
    have = df.select(*group, date).distinct()
    miss = calendar(df, group, date, start, end).join(have, [*group, date], "left_anti")
    w = W.partitionBy(*group).orderBy(date)
    island = miss.withColumn("_i", F.date_sub(F.col(date), F.row_number().over(w)))
    return island.groupBy(*group, "_i").agg(F.min(date).alias("gap_start"), F.max(date).alias("gap_end"), F.count("*").alias("days")).drop("_i")


def coverage(df: DataFrame, date: str, start: str, end: str, group: list[str]) -> DataFrame:
    """(group, total_days, present_days, missing_days, coverage_pct, gaps) within a range (A4)."""
    total = f"datediff(date'{end}', date'{start}') + 1"
    present = df.filter(F.col(date).between(start, end)).groupBy(*group).agg(F.count_distinct(date).alias("present_days"))
    holes = gaps(df, date, start, end, group).groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("gap_start", "gap_end", "days"))).alias("gaps"))
    out = df.select(*group).distinct().join(present, group, "left").join(holes, group, "left")
    n = F.coalesce("present_days", F.lit(0))
    return out.select(*group, F.expr(total).cast("long").alias("total_days"), n.alias("present_days"), (F.expr(total) - n).cast("long").alias("missing_days"), (100.0 * n / F.expr(total)).alias("coverage_pct"), F.coalesce("gaps", F.array()).alias("gaps"))


def scaffold(locations: DataFrame, start: str, end: str, columns: dict[str, str], key: str = "location_id") -> DataFrame:
    """Locations by days, with typed empty columns."""
    days = F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("datetime")
    return locations.select(key, days).select("*", *[F.lit(None).cast(t).alias(c) for c, t in columns.items()])
