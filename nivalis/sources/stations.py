"""Station sources: per-station Parquet files, fixed-width inventories and daily element files."""

from __future__ import annotations

import logging
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from nivalis.session import no_nan

TARGETS = {"snow_depth_cm": ("snow_depth_cm", "snowdepth", "snow_depth", "snwd"), "swe_mm": ("swe_mm", "swe", "wteq"), "temp_avg_c": ("temp_avg_c", "tempavg", "temp_avg", "tavg")}
#: Quality flags of daily files that mark a bad value.
BAD_FLAGS = ("D", "G", "I", "K", "L", "M", "N", "O", "R", "S", "T", "W", "X", "Z")
ELEMENTS = ("TMAX", "TMIN", "PRCP", "SNOW", "SNWD")


def resolve(names: list[str], wanted: dict[str, tuple[str, ...]]) -> dict[str, str]:
    """Target name: column, by exact match regardless of case, else by part of the name; in order of the candidates."""
    low, out = {n.lower(): n for n in reversed(names)}, {}
    for target, candidates in wanted.items():
        hit = next((low[c] for c in candidates if c in low), None) or next((n for c in candidates for n in names if c in n.lower()), None)
        if hit:
            out[target] = hit
    return out


def station_id(file_name: Column) -> Column:
    """`1050:CO:SNTL` from `1050_CO_SNTL_2023-01-01_2023-01-03.parquet`."""
    return F.concat_ws(":", F.slice(F.split(file_name, "_"), 1, 3))


def state_of(station: Column) -> Column:
    """`CO` of `1050:CO:SNTL`; NULL for ids of another form."""
    parts = F.split(station, ":")
    return F.when(F.size(parts) == 3, parts[1])


def limited(stations: DataFrame, most: int | None = None, station: str = "station_id") -> DataFrame:
    """The first `most` stations by id, where a caller asks for that (T7); else all."""
    return stations if most is None else stations.orderBy(station).limit(most)


def normalized(df: DataFrame, time_names=("datetime", "date", "time")) -> DataFrame:
    """Target columns, typed; a missing one is NULL."""
    found = resolve(df.columns, TARGETS | {"datetime": tuple(time_names)})
    if "datetime" not in found:
        raise ValueError("no time column")
    values = [F.col(found[t]).cast("double").alias(t) if t in found else F.lit(None).cast("double").alias(t) for t in TARGETS]
    return no_nan(df.select("station_id", F.col(found["datetime"]).cast("timestamp").alias("datetime"), *values))


def metric(df: DataFrame, units: str = "auto", group: str = "station_id") -> DataFrame:
    """Inches and Fahrenheit to metric (S3). auto: by each station's largest depth and water and mean temperature."""
    if units == "metric":
        return df
    w = W.partitionBy(group)
    yes = F.lit(True)
    depth, swe, warm = F.max("snow_depth_cm").over(w), F.max("swe_mm").over(w), F.avg("temp_avg_c").over(w)
    deep, wet, hot = ((depth > 0) & (depth < 200), (swe > 0) & (swe < 80), warm > 50) if units == "auto" else (yes, yes, yes)
    c = F.col
    return df.select(
        *[x for x in df.columns if x not in TARGETS], F.when(deep, c("snow_depth_cm") * 2.54).otherwise(c("snow_depth_cm")).alias("snow_depth_cm"),
        F.when(wet, c("swe_mm") * 25.4).otherwise(c("swe_mm")).alias("swe_mm"), F.when(hot, (c("temp_avg_c") - 32) * 5 / 9).otherwise(c("temp_avg_c")).alias("temp_avg_c"),
    )


def completeness(columns=tuple(TARGETS)) -> Column:
    """good, partial or missing, by how many of the columns have values."""
    n = sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))
    return F.when(n == len(columns), "good").when(n > 0, "partial").otherwise("missing")


def by_layout(spark: SparkSession, paths: list[str], at_once: int = 16) -> list[tuple[StructType, list[str]]]:
    """(columns and types, files) of Parquet files and folders: files that have the same ones together.

    Only a footer is read of each file, some files at once. A file that can't be read is left out with a warning."""
    files = sorted(spark.read.format("binaryFile").option("ignoreMissingFiles", "true").option("recursiveFileLookup", "true").load(list(paths)).inputFiles())

    def layout(file: str) -> StructType | None:
        try:
            return spark.read.parquet(file).schema
        except Exception as e:  # whatever Spark says of what isn't a Parquet file
            logging.getLogger(__name__).warning("%s left out: %s", file, str(e).splitlines()[0])

    found: dict[str, tuple[StructType, list[str]]] = {}
    with ThreadPoolExecutor(at_once) as pool:
        for file, schema in zip(files, pool.map(layout, files), strict=True):
            if schema is not None:
                found.setdefault(schema.json(), (schema, []))[1].append(file)
    return list(found.values())


def read_station_files(spark: SparkSession, paths: list[str], units: str = "auto") -> DataFrame:
    """Per-station Parquet files as one frame: station from the file's name, metric values, quality label.

    Files are read by layout, each layout with its own names and types of columns; what a file lacks is NULL. Files that can't
    be read, and those without a time column, are left out with a warning; if none is left, that is an error."""
    parts = []
    for schema, files in by_layout(spark, paths):
        raw = spark.read.schema(schema).option("ignoreCorruptFiles", "true").parquet(*files)
        try:
            parts.append(normalized(raw.withColumn("station_id", station_id(F.col("_metadata.file_name")))))
        except ValueError as e:
            logging.getLogger(__name__).warning("%s left out: %s", ", ".join(files), e)
    if not parts:
        raise ValueError("no station file can be read")
    out = metric(reduce(DataFrame.unionByName, parts), units)
    return out.withColumn("quality_flag", completeness())


def inventory(lines: DataFrame, min_elevation: float | None = None) -> DataFrame:
    """Stations of a fixed-width inventory (S5, P2). lines: value. Short and unreadable lines are left out."""
    part = lambda a, n: F.trim(F.substring("value", a, n))
    e = part(32, 6).try_cast("double")
    out = lines.filter(F.length("value") >= 40).select(part(1, 11).alias("station_id"), part(13, 8).try_cast("double").alias("lat"), part(22, 9).try_cast("double").alias("lon"), F.when(e.isNull() | (e <= -999), 0.0).otherwise(e).alias("elevation"), part(39, 2).alias("state"), part(42, 30).alias("name"))
    out = out.filter("lat is not null and lon is not null")
    return out if min_elevation is None else out.filter(F.col("elevation") >= min_elevation)


def daily_elements(lines: DataFrame, elements=ELEMENTS, first_year: int | None = None, last_year: int | None = None) -> DataFrame:
    """(station_id, date, element, value, mflag, qflag, sflag) of daily element lines, 31 values a line (S6). lines: value.
    Lines are filtered before they are cut; missing values and impossible dates are left out."""
    at = lambda a, n: F.substring("value", a, n)
    year = at(12, 4).try_cast("int")
    some = lines.filter(at(18, 4).isin(*elements) & year.isNotNull())
    some = some if first_year is None else some.filter(year >= first_year)
    some = some if last_year is None else some.filter(year <= last_year)
    day = F.explode(F.transform(F.sequence(F.lit(1), F.lit(31)), lambda d: F.struct(d.alias("day"), F.substring(F.col("value"), 22 + (d - 1) * 8, F.lit(8)).alias("block"))))
    cut = some.select(at(1, 11).alias("station_id"), year.alias("year"), at(16, 2).alias("month"), at(18, 4).alias("element"), day.alias("d"))
    flag = lambda k: F.nullif(F.trim(F.substring("d.block", k, 1)), F.lit(""))
    date = F.try_to_timestamp(F.concat_ws("-", F.col("year").cast("string"), "month", F.lpad(F.col("d.day").cast("string"), 2, "0")), F.lit("yyyy-MM-dd")).cast("date")
    out = cut.select("station_id", date.alias("date"), "element", F.trim(F.substring("d.block", 1, 5)).try_cast("int").alias("value"), flag(6).alias("mflag"), flag(7).alias("qflag"), flag(8).alias("sflag"))
    return out.filter("date is not null and value is not null and value <> -9999")


def converted(df: DataFrame) -> DataFrame:
    """`value_converted` and `unit`."""
    e = F.col("element")
    unit = F.when(e.isin("TMAX", "TMIN", "TAVG", "TOBS"), "celsius").when(e == "PRCP", "mm").when(e.isin("SNOW", "SNWD"), "cm")
    return df.select("*", F.when(unit.isNotNull(), F.col("value") / 10.0).otherwise(F.col("value").cast("double")).alias("value_converted"), F.coalesce(unit, F.lit("raw")).alias("unit"))


def good_only(df: DataFrame, flags=BAD_FLAGS) -> DataFrame:
    """Rows whose qflag isn't one of `flags`."""
    return df.filter(~F.coalesce("qflag", F.lit("")).isin(*flags))


def read_daily(spark: SparkSession, paths: list[str], start: str, end: str, **args) -> DataFrame:
    """Daily element files of a date range, good values only."""
    lines = spark.read.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").text(paths)
    out = daily_elements(lines, first_year=int(start[:4]), last_year=int(end[:4]), **args)
    return converted(good_only(out)).filter(F.col("date").between(start, end))


def wide(df: DataFrame, elements=ELEMENTS, value: str = "value_converted") -> DataFrame:
    """Long to wide: a column for each element."""
    return df.groupBy("station_id", "date").pivot("element", list(elements)).agg(F.avg(value))


#: Providers of stations and resorts, by name (X3): functions of a session.
PROVIDERS: dict[str, dict[str, Callable[[SparkSession], DataFrame]]] = {"station": {}, "resort": {}}


def register(kind: str, name: str, provider: Callable[[SparkSession], DataFrame]) -> None:
    PROVIDERS[kind][name] = provider


def clear() -> None:
    for x in PROVIDERS.values():
        x.clear()


def _registered(spark: SparkSession, kind: str) -> tuple[dict[str, DataFrame], list[str]]:
    """Frames of the registered providers of a kind, and what is wrong with the others. Each is asked for a row, so that
    one that can't be read at all is found here and doesn't take the others down."""
    frames, issues = {}, []
    for name, provider in PROVIDERS[kind].items():
        try:
            frame = provider(spark)
            collect_locations({name: frame}, kind).take(1)
            frames[name] = frame
        except Exception as e:  # a provider is any caller's function
            issues.append(f"{kind} provider {name}: {str(e).splitlines()[0] if str(e) else type(e).__name__}")
            logging.getLogger(__name__).warning("%s; left out", issues[-1])
    return frames, issues


def _chosen(out: DataFrame, states: list[str] | None, min_elevation: float | None) -> DataFrame:
    out = out if states is None else out.filter(F.col("state").isin(*states))
    return out if min_elevation is None else out.filter(F.col("elevation") >= min_elevation)


def collect_registered(spark: SparkSession, kind: str, states: list[str] | None = None, min_elevation: float | None = None) -> DataFrame:
    """Rows of all registered providers of a kind (U1, U2, X3), by state and elevation where asked. A provider that fails is left
    out with a warning; without any provider that is an error."""
    if not PROVIDERS[kind]:
        raise ValueError(f"no {kind} providers are registered")
    frames, _ = _registered(spark, kind)
    if not frames:
        raise ValueError(f"all {kind} providers failed")
    return _chosen(collect_locations(frames, kind), states, min_elevation)


class Collected(NamedTuple):
    """What all providers gave: `locations` (None if none gave any), the issues of the others, and a report of one row (U4)."""

    locations: DataFrame | None
    issues: list[str]
    report: DataFrame


def collect_all(spark: SparkSession, states: list[str] | None = None, min_elevation: float | None = None) -> Collected:
    """Stations and resorts of all registered providers (U4). State and elevation choose among stations only. It is a success if
    no provider failed and there was one; kinds without providers are left out without an issue."""
    parts, issues = [], []
    for kind in PROVIDERS:
        frames, wrong = _registered(spark, kind)
        issues += wrong
        if frames:
            found = collect_locations(frames, kind)
            parts.append(_chosen(found, states, min_elevation) if kind == "station" else found)
    if not parts:
        empty = spark.createDataFrame([], "location_id string, kind string, source string, name string, lat double, lon double, elevation double, state string")
        return Collected(None, issues, location_report(empty, issues).withColumn("success", F.lit(False)))
    out = reduce(DataFrame.unionByName, parts)
    return Collected(out, issues, location_report(out, issues).withColumn("success", F.lit(not issues)))


def extraction_points(locations: DataFrame) -> DataFrame:
    """(location_id, lat, lon) of the locations that have a place, for lookups in grids (U4)."""
    return locations.filter("lat is not null and lon is not null").select("location_id", "lat", "lon")


def collect_locations(frames: dict[str, DataFrame], kind: str) -> DataFrame:
    """Providers' rows in one schema, tagged with the source; rows without elevation are left out of stations.
    The id of a resort is a hash of what it is, for a row number isn't stable."""
    out = None
    for source, d in frames.items():
        have = set(d.columns)
        name = F.col("name") if "name" in have else F.lit(None).cast("string")
        elevation = F.col("elevation" if "elevation" in have else "base_elevation").cast("double")
        key = F.concat_ws("_", F.lit(kind), F.lit(source), F.col("station_id").cast("string") if kind == "station" else F.xxhash64(F.lit(source), name, F.col("lat"), F.col("lon")).cast("string"))
        one = d.select(key.alias("location_id"), F.lit(kind).alias("kind"), F.lit(source).alias("source"), name.alias("name"), F.col("lat").cast("double"), F.col("lon").cast("double"), elevation.alias("elevation"), (F.col("state") if "state" in have else F.lit(None).cast("string")).alias("state"))
        one = one.filter("elevation is not null") if kind == "station" else one
        out = one if out is None else out.unionByName(one)
    return out


def location_report(locations: DataFrame, issues: list[str] = ()) -> DataFrame:
    """One row: counts in all, by kind, source and state (U4, A34), and what went wrong."""
    def counts(c: str) -> DataFrame:
        return locations.groupBy(c).count().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce(c, F.lit("unknown")), "count")))).alias(f"by_{c}"))

    total = locations.agg(F.count("*").alias("total"), F.count_if(F.col("lat").isNull() | F.col("lon").isNull()).alias("without_place"))
    for c in ("kind", "source", "state"):
        total = total.crossJoin(counts(c))  # one row each
    told = F.array(*map(F.lit, issues)) if issues else F.array().cast("array<string>")
    return total.withColumn("issues", told).withColumn("success", F.col("total") > 0)
