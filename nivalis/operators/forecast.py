"""Forecast lookup: as-of joins, fallback chains, request expansion, carried-forward depth, snow events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nivalis.functions import snow

#: Named time steps.
TIME_STEPS = ("Now", "Tonight", "Tomorrow AM", "Tomorrow PM", "Day 3", "Day 4", "Day 5", "Day 6", "Day 7")


def as_of(requests: DataFrame, forecasts: DataFrame, hours: int = 6, max_age_hours: int | None = None, as_of_ts: Column | None = None) -> DataFrame:
    """For each request (request_id, location_id, want) the forecast of its place valid within `hours`: the latest run first,
    then the nearest valid time, then the earlier (J9). Requests without any have NULLs.

    Valid times are cut into bins of `hours`; a request looks into its own bin and both neighbours."""
    width = hours * 3600
    number = lambda c: F.floor(F.unix_timestamp(F.col(c).cast("timestamp")) / width)
    f = forecasts if max_age_hours is None else forecasts.filter(F.col("run_time") >= as_of_ts - F.make_dt_interval(hours=F.lit(max_age_hours)))
    f = f.withColumn("_bin", number("valid_time"))
    r = requests.select("request_id", "location_id", "want", F.explode(F.array(*[number("want") + i for i in (-1, 0, 1)])).alias("_bin"))
    apart = F.abs(F.timestamp_diff("SECOND", F.col("want"), F.col("valid_time")))
    hit = r.join(f, ["location_id", "_bin"]).withColumn("_apart", apart).filter(F.col("_apart") <= width)
    kept = [c for c in forecasts.columns if c != "location_id"]
    ties = [c for c in ("forecast_hour",) if c in forecasts.columns]
    # a minimum, so that most rows go before the shuffle
    age = F.coalesce(-F.unix_micros(F.col("run_time").cast("timestamp")), F.lit(2**62))
    best = hit.groupBy("request_id").agg(F.min_by(F.struct(*kept), F.struct(age.alias("a"), "_apart", "valid_time", *ties)).alias("b"))
    return requests.join(best.select("request_id", "b.*"), "request_id", "left")


def latest(forecasts: DataFrame) -> DataFrame:
    """The forecast of the last valid time of each place."""
    rest = [c for c in forecasts.columns if c not in ("location_id", "valid_time", "run_time")]
    best = F.max(F.struct("valid_time", "run_time", *rest)).alias("b")
    return forecasts.groupBy("location_id").agg(best).select("location_id", "b.*")


def requests(locations: DataFrame, base: Column, steps=TIME_STEPS) -> DataFrame:
    """(location_id, step, want, hours_ahead): every place at every named step."""
    out = locations.select("location_id", F.explode(F.array(*map(F.lit, steps))).alias("step")).withColumn("want", snow.target_time(F.col("step"), base))
    return out.withColumn("hours_ahead", snow.hours_ahead(F.col("want"), base))


def predicted(df: DataFrame) -> DataFrame:
    """The forecast by the fallback chain (J15, F27-F30) of rows with hrrr_*, nbm_* and last_* columns, slope and aspect:
    the first source that has a temperature (last: a depth) is used, and without any all is 0."""
    c = F.col
    have_h, have_n, have_l = c("hrrr_temp_k").isNotNull(), c("nbm_temp_k").isNotNull(), c("last_depth_m").isNotNull()
    t = c("hrrr_temp_k") - 273.15
    n_new = c("nbm_new_m") * 100
    fresh = F.when(have_h, snow.new_snow_cm(t, c("hrrr_precip_mm"))).when(have_n, n_new).otherwise(0.0)
    depth = F.when(have_h, c("hrrr_depth_m") * 100).when(have_n, c("nbm_depth_m") * 100).when(have_l, c("last_depth_m") * 100).otherwise(0.0)
    wet = c("hrrr_precip_mm") > 0
    p_h = F.when(c("hrrr_categorical") > 0.5, 0.9).when((t < -2) & wet, 0.7).when((t < 2) & wet, 0.4).otherwise(0.1)
    p_n = F.when(n_new > 5, 0.85).when(n_new > 1, 0.6).when(n_new > 0, 0.3).otherwise(0.1)
    p = F.when(have_h, p_h).when(have_n, p_n).when(have_l, 0.1).otherwise(0.0)
    half = F.when(have_h, F.greatest(F.lit(2.0), fresh * 0.3)).when(have_n, F.greatest(F.lit(3.0), fresh * 0.4)).when(have_l, 5.0).otherwise(0.0)
    slope, aspect = F.coalesce(c("slope"), F.lit(snow.TERRAIN_DEFAULTS["slope"])), F.coalesce(c("aspect"), F.lit(snow.TERRAIN_DEFAULTS["aspect"]))
    fresh = F.when(slope > 30, fresh * 0.9).otherwise(fresh)
    depth = F.when((aspect >= 315) | (aspect <= 45), depth * 1.05).otherwise(depth)
    zero = F.lit(0.0)
    source = F.when(have_h, "HRRR").when(have_n, "NBM").when(have_l, "persistence").otherwise("none")
    return df.select(
        "request_id", source.alias("source"), snow.half_even(F.greatest(zero, depth), 1).alias("snow_depth_cm"), snow.half_even(F.greatest(zero, fresh), 1).alias("new_snow_cm"),
        F.greatest(F.lit(0.01), F.least(F.lit(0.99), p)).alias("probability"), snow.half_even(F.greatest(zero, fresh - half), 1).alias("ci_lower"), snow.half_even(fresh + half, 1).alias("ci_upper"),
    )


def carried_forward(df: DataFrame, melt: float = 0.995) -> DataFrame:
    """Seven-day depth (W11): days 0 and 1 as given; later the last positive of them, melting daily, and all new snow since.
    df: location_id, day, snow_depth_cm, new_snow_cm."""
    w = W.partitionBy("location_id").orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    base = F.last(F.when((F.col("day") <= 1) & (F.col("snow_depth_cm") > 0), F.col("snow_depth_cm")), True).over(w)
    fresh = F.sum(F.when(F.col("day") >= 2, F.col("new_snow_cm"))).over(w)
    later = F.coalesce(base * F.pow(F.lit(melt), F.col("day") - 1) + F.coalesce(fresh, F.lit(0.0)), F.col("snow_depth_cm"))
    return df.withColumn("snow_depth_cm", F.greatest(F.lit(0.0), F.when(F.col("day") <= 1, F.col("snow_depth_cm")).otherwise(later)))


def snow_events(df: DataFrame, group: list[str], date: str = "date", value: str = "new_snow_cm", least: float = 5.0) -> DataFrame:
    """Runs of rows with at least `least` new snow (W10): start, end, days, total, largest day and its class. NULL is none."""
    w = W.partitionBy(*group).orderBy(date)
    x = df.withColumn("_v", F.coalesce(F.col(value), F.lit(0.0))).withColumn("_on", F.col("_v") >= least).withColumn("_n", F.row_number().over(w))
    on = x.filter("_on").withColumn("_i", F.col("_n") - F.row_number().over(w))
    out = on.groupBy(*group, "_i").agg(F.min(date).alias("start_date"), F.max(date).alias("end_date"), F.count("*").alias("days"), F.sum("_v").alias("total_cm"), F.max("_v").alias("max_cm")).drop("_i")
    return out.withColumn("intensity", snow.intensity(F.col("max_cm")))


def summary(df: DataFrame, group: list[str], date: str = "date") -> DataFrame:
    """A sentence for each group's forecast (F39). df: date, new_snow_cm, snow_depth_cm."""
    name = lambda d: F.date_format(d, "EEEE")
    days = F.when((F.col("start_date") == F.col("end_date")) | (name("start_date") == name("end_date")), name("start_date")).otherwise(F.concat(name("start_date"), F.lit("-"), name("end_date")))
    cm = F.concat(F.lit(" ("), F.bround("total_cm", 0).cast("long").cast("string"), F.lit("cm)"))
    word = F.when(F.col("intensity") == "very heavy", "Very heavy snow expected ").when(F.col("intensity") == "heavy", "Heavy snow expected ").when(F.col("intensity") == "moderate", "Moderate snow ").otherwise("Light snow ")
    told = snow_events(df, group, date).groupBy(*group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_date", F.concat(word, days, cm).alias("t")))), lambda s: s["t"]), ". ").alias("events"))
    whole = df.groupBy(*group).agg(F.min_by("snow_depth_cm", date).alias("depth"), F.coalesce(F.sum("new_snow_cm"), F.lit(0.0)).alias("total"))
    base = F.when(F.col("depth") > 100, "Excellent base conditions.").when(F.col("depth") > 60, "Good base conditions.").when(F.col("depth") > 30, "Fair base conditions.").otherwise("Limited base coverage.")
    quiet = F.when(F.col("total") < 1, F.lit("Dry week ahead")).otherwise(F.concat(F.lit("Light flurries possible ("), F.bround("total", 0).cast("long").cast("string"), F.lit("cm total)")))
    return whole.join(told, group, "left").select(*group, F.concat(F.coalesce("events", quiet), F.lit(". "), base).alias("summary"))


def terrain_of(requests: DataFrame, terrain: DataFrame) -> DataFrame:
    """Requests with their place's terrain, or the defaults."""
    out = requests.join(terrain, "location_id", "left")
    return out.select(*requests.columns, *[F.coalesce(c, F.lit(v)).alias(c) for c, v in snow.TERRAIN_DEFAULTS.items() if c in terrain.columns])


def checked_requests(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests in range, and the others with a reason."""
    reason = F.when(~F.coalesce(F.col("lat").between(31, 49), F.lit(False)), "latitude").when(~F.coalesce(F.col("lon").between(-125, -102), F.lit(False)), "longitude").when(~F.coalesce(F.col("hours").between(1, 168), F.lit(False)), "hours")
    judged = df.withColumn("reason", reason)
    return judged.filter("reason is null").drop("reason"), judged.filter("reason is not null")


def defaults(df: DataFrame) -> DataFrame:
    """A fetched record without NULLs (P9): depth 0, 273 K, precipitation 0."""
    fill = {"snow_depth_m": 0.0, "temp_k": 273.0, "precip_mm": 0.0, "categorical_snow": 0.0}
    return df.select(*[F.coalesce(c, F.lit(fill[c])).alias(c) if c in fill else F.col(c) for c in df.columns])
