"""Validation of sources (A5-A11): one row of figures, `issues` (names of what is wrong) and `valid`.

Figures come from one pass over the rows. Empty frames aren't valid, and all of their values count as missing."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nivalis.sources.stations import BAD_FLAGS

TERRAIN = ("elevation", "slope", "aspect", "roughness", "tpi")
LABELS = ("good", "partial", "missing")


def outside(c: str, low: float | None, high: float | None) -> Column:
    parts = [F.col(c) < low] * (low is not None) + [F.col(c) > high] * (high is not None)
    return reduce(lambda a, b: a | b, parts)


def missing_pct(columns: list[str]) -> Column:
    """Share of missing values; all of them in an empty frame, and none of no columns."""
    if not columns:
        return F.lit(0.0)
    gone = reduce(lambda a, b: a + b, [F.count_if(F.col(c).isNull()) for c in columns])
    return F.coalesce(F.try_divide(gone * 100.0, F.count("*") * len(columns)), F.lit(100.0))


def judged(figures: DataFrame, issues: dict[str, Column], valid: Column | None = None) -> DataFrame:
    """`figures` (with `total`) and the names of the issues that hold; valid is that there are rows and none does, and `valid`."""
    named = F.filter(F.array(F.when(F.col("total") == 0, F.lit("no rows")), *[F.when(c, F.lit(n)) for n, c in issues.items()]), lambda x: x.isNotNull())
    ok = F.size("issues") == 0
    return figures.withColumn("issues", named).withColumn("valid", ok if valid is None else ok & F.coalesce(valid, F.lit(False)))


def _absent(df: DataFrame, columns: tuple[str, ...]) -> dict[str, Column]:
    return {f"no column {c}": F.lit(True) for c in columns if c not in df.columns}


def snotel(df: DataFrame, max_missing: float = 30.0) -> DataFrame:
    """Daily station records (A5): ranges of depth, water and temperature, stations, dates, quality labels."""
    have = [c for c in ("snow_depth_cm", "swe_mm", "temp_avg_c") if c in df.columns]
    bad = {"depth_range": ("snow_depth_cm", 0.0, 2000.0), "swe_range": ("swe_mm", 0.0, 5000.0), "temp_range": ("temp_avg_c", -60.0, 50.0)}
    counts = {n: F.count_if(outside(*x)) for n, x in bad.items() if x[0] in have}
    labels = [F.lit(x) if k == 0 else F.count_if(F.col("quality_flag") == x) for x in LABELS for k in (0, 1)] if "quality_flag" in df.columns else []
    figures = df.agg(
        F.count("*").alias("total"), missing_pct(have).alias("missing_pct"), *[c.alias(n) for n, c in counts.items()],
        F.count_distinct("station_id").alias("stations"), F.min("datetime").alias("first"), F.max("datetime").alias("last"),
        (F.create_map(*labels) if labels else F.lit(None).cast("map<string,bigint>")).alias("labels"),
    )
    wanted = ("station_id", "datetime", "snow_depth_cm", "swe_mm", "temp_avg_c", "quality_flag")
    return judged(figures, _absent(df, wanted) | {"missing": F.col("missing_pct") > max_missing} | {n: F.col(n) > 0 for n in counts})


def ghcn(df: DataFrame, max_missing: float = 20.0, max_flagged: float = 10.0) -> DataFrame:
    """Daily elements (A6): share of flagged values, temperature and precipitation out of range, stations, elements, dates."""
    e, v = F.col("element"), "value_converted"
    figures = df.agg(
        F.count("*").alias("total"), missing_pct(["value"]).alias("missing_pct"),
        F.coalesce(F.try_divide(F.count_if(F.col("qflag").isin(*BAD_FLAGS)) * 100.0, F.count("*")), F.lit(0.0)).alias("flagged_pct"),
        F.count_if(e.isin("TMAX", "TMIN") & outside(v, -60.0, 60.0)).alias("temp_range"), F.count_if((e == "PRCP") & (F.col(v) > 2000)).alias("precip_range"),
        F.count_distinct("station_id").alias("stations"), F.array_sort(F.collect_set("element")).alias("elements"), F.min("date").alias("first"), F.max("date").alias("last"),
    )
    return judged(figures, {"flagged": F.col("flagged_pct") > max_flagged, "temp_range": F.col("temp_range") > 0, "precip_range": F.col("precip_range") > 0}, F.col("missing_pct") < max_missing)


def era5(df: DataFrame, variables: list[str], ts: str = "time", max_missing: float = 20.0, max_gap_hours: float = 24.0) -> DataFrame:
    """Grid rows (A7): of each variable the missing share, least, largest and mean; Kelvin and precipitation in range; the
    longest gap between times."""
    from nivalis.operators.lagged import largest_gap_hours

    per = [x for v in variables for x in (missing_pct([v]).alias(f"{v}_missing_pct"), F.min(v).alias(f"{v}_min"), F.max(v).alias(f"{v}_max"), F.avg(v).alias(f"{v}_mean"))]
    figures = df.agg(F.count("*").alias("total"), *per)
    gap = largest_gap_hours(df.select(ts).distinct().withColumn("_all", F.lit(0)), ts, ["_all"])  # a row a time
    figures = figures.join(gap.agg(F.max("hours").alias("largest_gap_hours")), how="cross")  # one row each
    mean = reduce(lambda a, b: a + b, [F.col(f"{v}_missing_pct") for v in variables]) / len(variables)
    issues = {f"{v} is empty": F.col(f"{v}_missing_pct") == 100 for v in variables}
    issues |= {f"{v} range": (F.col(f"{v}_min") < 180) | (F.col(f"{v}_max") > 350) for v in variables if v in ("t2m", "d2m") or "temperature" in v.lower()}
    issues |= {f"{v} negative": F.col(f"{v}_min") < -0.001 for v in variables if v in ("tp", "sf") or "precip" in v.lower()}
    issues["gap"] = F.col("largest_gap_hours") > max_gap_hours
    return judged(figures.withColumn("missing_pct", mean), issues, F.col("missing_pct") < max_missing)


def frame(df: DataFrame, max_missing: float = 20.0) -> DataFrame:
    """Any flat frame (A7): missing share of all columns, and columns without any value."""
    figures = df.agg(F.count("*").alias("total"), missing_pct(df.columns).alias("missing_pct"), *[F.count(c).alias(f"_{i}") for i, c in enumerate(df.columns)])
    empty = F.filter(F.array(*[F.when(F.col(f"_{i}") == 0, F.lit(c)) for i, c in enumerate(df.columns)]), lambda x: x.isNotNull())
    out = figures.select("total", "missing_pct", F.lit(len(df.columns)).alias("columns"), empty.alias("empty_columns"))
    return judged(out, {"empty columns": F.size("empty_columns") > 0}, F.col("missing_pct") < max_missing)


def hrrr(df: DataFrame, max_missing: float = 50.0) -> DataFrame:
    """Forecast rows (A8): temperature in Kelvin."""
    figures = df.agg(F.count("*").alias("total"), missing_pct(["temp_k"]).alias("missing_pct"), F.count_if(outside("temp_k", 180.0, 340.0)).alias("temp_range"))
    return judged(figures, {"missing": F.col("missing_pct") > max_missing, "temp_range": F.col("temp_range") > 0})


def terrain(df: DataFrame, max_missing: float = 50.0) -> DataFrame:
    """Terrain features (A9), or, of a catalogue of tiles, how many there are."""
    have = [c for c in TERRAIN if c in df.columns]
    if not have and "tile" in df.columns:
        return judged(df.agg(F.count("*").alias("total"), F.lit(0.0).alias("missing_pct"), F.lit("tiles").alias("kind")), {})
    stats = [f(c).alias(f"{c}_{n}") for c, n, f in (("elevation", "min", F.min), ("elevation", "max", F.max), ("elevation", "mean", F.avg), ("slope", "max", F.max), ("slope", "mean", F.avg)) if c in have]
    bad = [F.count_if(outside(c, low, high)) for c, low, high in (("elevation", -500.0, 9000.0), ("slope", None, 90.0)) if c in have]
    figures = df.agg(F.count("*").alias("total"), missing_pct(have).alias("missing_pct"), F.lit("features").alias("kind"), reduce(lambda a, b: a + b, bad, F.lit(0)).alias("outliers"), *stats)
    return judged(figures, {"no features": F.lit(not have), "outliers": F.col("outliers") > 0}, F.col("missing_pct") < max_missing)


def resorts(df: DataFrame) -> DataFrame:
    """Ski areas (A10): places in range, statistics of elevations; odd elevations are counted but not wrong."""
    have = [c for c in ("name", "lat", "lon") if c in df.columns]
    heights = [c for c in ("base_elevation", "summit_elevation") if c in df.columns]
    place = {f"{c}_range": F.count_if(outside(c, -x, x)) for c, x in (("lat", 90.0), ("lon", 180.0)) if c in have}
    odd = reduce(lambda a, b: a + b, [F.count_if(outside(c, 0.0, {"base_elevation": 5000.0, "summit_elevation": 6000.0}[c])) for c in heights], F.lit(0))
    stats = [f(c).alias(f"{c}_{n}") for c in heights for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))]
    with_both = F.floor(reduce(lambda a, b: a + b, [F.count(c) for c in heights], F.lit(0)) / 2)
    figures = df.agg(F.count("*").alias("total"), missing_pct(have).alias("missing_pct"), *[c.alias(n) for n, c in place.items()], odd.alias("outliers"), with_both.alias("with_elevation"), *stats)
    return judged(figures, _absent(df, ("name", "lat", "lon")) | {n: F.col(n) > 0 for n in place})


def run(read: Callable[[], DataFrame], process: Callable[[DataFrame], DataFrame], validate: Callable[[DataFrame], DataFrame], strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """A source's run (A11): (what `process` makes of what is read, its one-row report). With `strict`, an invalid one raises."""
    out = process(read())
    report = validate(out)
    if strict:
        row = report.select("valid", "issues").first()
        if not row.valid:
            raise ValueError(f"not valid: {', '.join(row.issues)}")
    return out, report
