"""The forecast store: Parquet tables with keyed upserts, retention, refresh and status."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = ("run_time", "forecast_hour", "location_id")
#: Ski areas (name, latitude, longitude, state, base elevation in metres).
SKI_AREAS = [
    ("Stevens Pass", 47.7448, -121.0890, "Washington", 1241), ("Crystal Mountain", 46.9282, -121.5045, "Washington", 1341), ("Mt. Baker", 48.8570, -121.6695, "Washington", 1280), ("Snoqualmie Pass", 47.4204, -121.4138, "Washington", 921),
    ("Mt. Hood Meadows", 45.3311, -121.6647, "Oregon", 1524), ("Mt. Bachelor", 43.9792, -121.6886, "Oregon", 1920), ("Timberline", 45.3311, -121.7110, "Oregon", 1829),
    ("Mammoth Mountain", 37.6308, -119.0326, "California", 2424), ("Squaw Valley", 39.1969, -120.2358, "California", 1890), ("Heavenly", 38.9353, -119.9400, "California", 2001), ("Kirkwood", 38.6850, -120.0652, "California", 2377),
    ("Vail", 39.6403, -106.3742, "Colorado", 2476), ("Breckenridge", 39.4817, -106.0384, "Colorado", 2926), ("Aspen Snowmass", 39.2084, -106.9490, "Colorado", 2473), ("Telluride", 37.9375, -107.8123, "Colorado", 2659),
    ("Park City", 40.6514, -111.5080, "Utah", 2103), ("Snowbird", 40.5830, -111.6538, "Utah", 2365), ("Alta", 40.5884, -111.6386, "Utah", 2600), ("Big Sky", 45.2618, -111.4018, "Montana", 2072), ("Whitefish", 48.4820, -114.3556, "Montana", 1463),
    ("Jackson Hole", 43.5875, -110.8279, "Wyoming", 1924), ("Sun Valley", 43.6804, -114.4075, "Idaho", 1752),
]
DEFAULT_VERTICAL = 800.0


#: Height between the base and the summit of ski areas in metres.
VERTICAL = {
    "Stevens Pass": 823, "Crystal Mountain": 884, "Mt. Baker": 457, "Snoqualmie Pass": 610, "Mt. Hood Meadows": 884, "Mt. Bachelor": 1070, "Timberline": 1067, "Mammoth Mountain": 945,
    "Squaw Valley": 869, "Heavenly": 1067, "Kirkwood": 610, "Vail": 1064, "Breckenridge": 884, "Aspen Snowmass": 1040, "Telluride": 1100, "Park City": 945, "Snowbird": 960, "Alta": 671,
    "Big Sky": 1330, "Whitefish": 713, "Jackson Hole": 1261, "Sun Valley": 1036,
}
#: Fixed values of the daily refresh (S24): (model, days ahead, forecast hour from the day's own run, longest forecast, days a run may be old).
SCHEDULE = [("HRRR", d, 12 + 24 * d, 48, 1) for d in range(2)] + [("NBM", d, 24 * d, 264, 2) for d in range(2, 7)]
LEAST_DAYS = 4


def newest(df: DataFrame, key: list[str], by: list[Column]) -> DataFrame:
    """One row a key: the last by `by`, NULLs last. A maximum, so that most rows go before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    order = F.struct(*[x for i, c in enumerate(by) for x in (c.isNotNull().alias(f"h{i}"), c.alias(f"v{i}"))])
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_b")).select(*key, "_b.*").select(*df.columns)


def merged(old: DataFrame | None, new: DataFrame, key: list[str] = KEY, by: str = "fetch_time") -> DataFrame:
    """Old and new rows with the newest of each key."""
    both = new if old is None else old.unionByName(new, allowMissingColumns=True)
    return newest(both, list(key), [F.col(by)])


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    return _files(spark, path).exists(_path(spark, path))


def _beside(path: str, what: str) -> str:
    """A path beside `path` that no other writer uses."""
    return f"{path.rstrip('/')}_{what}_{uuid.uuid4().hex}"


def upsert_forecasts(new: DataFrame, path: str) -> None:
    """Writes forecasts, keeping the newest of each key; only the run dates they touch are rewritten (S17). What is
    kept of them is written beside the table first, for a path can't be read and overwritten in one plan."""
    spark = new.sparkSession
    new = new.withColumn("valid_time", F.col("run_time") + F.make_dt_interval(hours=F.col("forecast_hour"))).withColumn("run_date", F.col("run_time").cast("date"))
    old = None
    if _exists(spark, path):
        touched = new.select("run_date").distinct()
        old = spark.read.parquet(path).join(F.broadcast(touched), "run_date", "left_semi")  # some dates
    side = _beside(path, "next")
    merged(old, new).write.parquet(side)
    spark.read.parquet(side).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_date").parquet(path)
    _files(spark, side).delete(_path(spark, side), True)


def retained(df: DataFrame, as_of: Column, keep_days: int = 7) -> DataFrame:
    """Forecasts no older than `keep_days` (S20). The run date's own condition lets whole partitions be skipped."""
    limit = as_of - F.make_dt_interval(days=F.lit(keep_days))
    out = df.filter(F.col("run_time") >= limit)
    return out.filter(F.col("run_date") >= limit.cast("date")) if "run_date" in df.columns else out


def insert_absent(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of `new` whose key `old` hasn't."""
    return new.join(old.select(key), key, "left_anti")


def log_row(spark: SparkSession, path: str, source: str, timestamp: str, status: str, records: int, ms: int, error: str | None = None) -> None:
    """Appends to the fetch log."""
    spark.createDataFrame([(source, timestamp, status, records, ms, error)], "source string, ts string, status string, records_added int, duration_ms int, error_message string").withColumn("timestamp", F.col("ts").cast("timestamp")).drop("ts").write.mode("append").parquet(path)


def stale(areas: DataFrame, forecasts: DataFrame, as_of: Column, max_age_hours: int) -> DataFrame:
    """Places without a fresh forecast."""
    fresh = forecasts.filter(F.col("run_time") >= as_of - F.make_dt_interval(hours=F.lit(max_age_hours)))
    return areas.join(fresh.select("location_id"), "location_id", "left_anti")


def status(areas: DataFrame, forecasts: DataFrame, terrain: DataFrame) -> DataFrame:
    """Each place: whether it has forecasts and terrain, its last run, how many."""
    f = forecasts.groupBy("location_id").agg(F.max("run_time").alias("last_run"), F.count("*").alias("n"))
    t = terrain.select("location_id", F.lit(True).alias("t")).distinct()
    return areas.select("location_id").join(f, "location_id", "left").join(t, "location_id", "left").select("location_id", F.col("last_run").isNotNull().alias("has_forecast"), F.coalesce("t", F.lit(False)).alias("has_terrain"), "last_run", F.coalesce("n", F.lit(0)).alias("forecasts"))


def stats(forecasts: DataFrame, terrain: DataFrame) -> DataFrame:
    """One row: how many forecasts and terrain records, last run."""
    return forecasts.agg(F.count("*").alias("forecasts"), F.max("run_time").alias("last_run")).crossJoin(terrain.agg(F.count("*").alias("terrain")))  # one row each


def outcomes(log: DataFrame) -> DataFrame:
    """One row of a fetch log: total, success, failed, records, success share."""
    return log.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "success").alias("success"), F.count_if(F.col("status") != "success").alias("failed"), F.coalesce(F.sum("records_added"), F.lit(0)).alias("records"), F.try_divide(F.count_if(F.col("status") == "success"), F.count("*")).alias("success_rate"))


def available_runs(wanted: DataFrame, runs: DataFrame) -> DataFrame:
    """For each wanted (day, model, fxx) the latest run that began by the day's end (S24); runs: model, run_time.

    Runs are first reduced to one a model and day; the last one carried along the days of a model is the answer."""
    day = (F.col("run_time") - F.expr("interval 1 microsecond")).cast("date")  # a run at the next midnight still counts
    daily = runs.groupBy("model", day.alias("day")).agg(F.max("run_time").alias("run_time"))
    both = daily.join(wanted.select("model", "day").distinct(), ["model", "day"], "full_outer")
    w = W.partitionBy("model").orderBy("day").rowsBetween(W.unboundedPreceding, 0)  # a row a model and day
    return wanted.join(both.select("model", "day", F.last("run_time", True).over(w).alias("run_time")), ["model", "day"], "left").filter("run_time is not null")


def schedule(spark: SparkSession, today: str) -> DataFrame:
    """(model, day, run_time, forecast_hour, age): all runs that can serve the seven days from `today` on (S23, S24). A run that
    is `age` days old serves a day with a forecast hour 24 higher for each, as far as the model reaches."""
    rows = [(m, d, fxx + 24 * age, age) for m, d, fxx, longest, oldest in SCHEDULE for age in range(oldest + 1) if fxx + 24 * age <= longest]
    return spark.createDataFrame(rows, "model string, ahead int, forecast_hour int, age int").select(
        "model", F.date_add(F.lit(today).cast("date"), F.col("ahead")).alias("day"), F.date_add(F.lit(today).cast("date"), F.col("ahead") - F.col("age")).cast("timestamp_ntz").alias("run_time"), "forecast_hour", "age"
    )


def first_runs(wanted: DataFrame, runs: DataFrame) -> DataFrame:
    """For each day and model the youngest wanted run that is there. runs: model, run_time, forecast_hour."""
    there = wanted.join(runs.select("model", "run_time", "forecast_hour").distinct(), ["model", "run_time", "forecast_hour"], "left_semi")
    return there.groupBy("model", "day").agg(F.min_by(F.struct("run_time", "forecast_hour"), "age").alias("b")).select("model", "day", "b.*")


def refreshed(areas: DataFrame, cells: DataFrame, grid: DataFrame, today: str) -> tuple[DataFrame, DataFrame]:
    """Forecasts of the seven days from `today` for all places (S23), and a row that says of how many days, and whether those are
    enough (S24). areas: location_id, lat, lon; cells: cell_id, lat, lon; grid: model, run_time, forecast_hour, cell_id, and
    values. Places without a value of snow depth have no forecast."""
    from nivalis.operators.forecast import defaults
    from nivalis.operators.spatial import nearest_cell_map

    picked = first_runs(schedule(areas.sparkSession, today), grid)  # seven rows
    where = nearest_cell_map(areas.withColumnRenamed("location_id", "point_id"), cells).withColumnRenamed("point_id", "location_id")
    rows = grid.filter("snow_depth_m is not null").join(F.broadcast(picked), ["model", "run_time", "forecast_hour"])
    out = defaults(rows.join(where, "cell_id").drop("cell_id"))
    out = out.withColumn("valid_time", F.col("run_time") + F.make_dt_interval(hours=F.col("forecast_hour")))
    done = picked.agg(F.count_distinct("day").alias("days")).withColumn("enough", F.col("days") >= LEAST_DAYS)
    return out, done


def upsert_terrain(new: DataFrame, path: str, key: tuple[str, ...] = ("lat", "lon"), by: str = "fetch_time") -> None:
    """Writes terrain, keeping the newest of each place (S18). The new table is written whole beside the old one, and then
    takes its place by name: at any moment one whole table is there, under a name that no other writer uses."""
    spark = new.sparkSession
    old = spark.read.parquet(path) if _exists(spark, path) else None
    side, before = _beside(path, "next"), _beside(path, "before")
    merged(old, new, list(key), by).write.parquet(side)
    files = _files(spark, path)
    if old is not None and not files.rename(_path(spark, path), _path(spark, before)):
        raise OSError(f"{path} can't be put aside; what is new is in {side}")
    if not files.rename(_path(spark, side), _path(spark, path)):
        raise OSError(f"{side} can't be put in place; what was there is in {before}")
    if old is not None:
        files.delete(_path(spark, before), True)


def save(df: DataFrame, path: str) -> None:
    """Observations, terrain or resorts as one Parquet table."""
    df.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A saved table (S15); `columns` are those that it must have."""
    out = spark.read.parquet(path)
    if missing := [c for c in columns or [] if c not in out.columns]:
        raise ValueError(f"{path} has no columns {missing}")
    return out


def save_grid(df: DataFrame, path: str, ts: str = "run_time") -> None:
    """Grid rows by year and month, in order of run and hour within a file (S16); only the months in `df` are rewritten."""
    parted = df.withColumn("year", F.year(ts)).withColumn("month", F.month(ts))
    order = [c for c in (ts, "forecast_hour") if c in df.columns]
    spread = [c for c in ("forecast_hour",) if c in df.columns]  # a month isn't one task's
    parted.repartition("year", "month", *spread).sortWithinPartitions("year", "month", *order).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year", "month").parquet(path)


def with_summit(areas: DataFrame, vertical: dict[str, float] | None = None) -> DataFrame:
    """`areas` (name, base_elevation) with the summit's elevation: by the areas' known height, else 800 m."""
    known = areas.sparkSession.createDataFrame([(n, float(v)) for n, v in (VERTICAL if vertical is None else vertical).items()], "name string, _v double")
    out = areas.join(F.broadcast(known), "name", "left")  # a row a name
    return out.withColumn("summit_elevation", F.col("base_elevation") + F.coalesce("_v", F.lit(DEFAULT_VERTICAL))).drop("_v")
