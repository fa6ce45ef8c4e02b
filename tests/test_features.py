"""Calendar frames, frequencies, file layouts, exact quantiles, raster holes, missing features, search and repeated batches."""

import datetime as dt
import math
import random
import statistics

import pandas as pd
import pytest
from pyspark.sql import functions as F

from nivalis import models
from nivalis.functions import calendar, geo, snow
from nivalis.operators import forecast, lagged, quality, raster, temporal, verification
from nivalis.operators.ranking import contiguous_folds, exact_quantiles
from nivalis.sources import stations, store
from nivalis.streaming import jobs

DAY = dt.date(2024, 1, 1)


def test_frames_of_calendar_days(spark):
    """Days 0, 1 (twice), 4, 9; another group on the same days."""
    rows = [("a", 0, 1.0), ("a", 1, 2.0), ("a", 1, 4.0), ("a", 4, 8.0), ("a", 9, 16.0), ("b", 1, 100.0), ("b", None, 5.0)]
    df = spark.createDataFrame([(g, d if d is None else DAY + dt.timedelta(d), v) for g, d, v in rows], "g string, date date, v double")
    out = lagged.features(df, ["v"], "g", lags=(1, 3), windows=(3,), frame="days").collect()
    a = {(r.date and (r.date - DAY).days, r.v): r for r in out if r.g == "a"}
    assert [a[1, x].v_lag_1d for x in (2.0, 4.0)] == [1.0, 1.0] and a[4, 8.0].v_lag_3d == 3.0 and a[4, 8.0].v_lag_1d is None
    assert a[1, 2.0].v_cumsum_3d == 7.0 and a[4, 8.0].v_cumsum_3d == 8.0 and a[4, 8.0].v_change_3d == 5.0 and a[9, 16.0].v_roll_mean_3d == 16.0
    assert a[1, 4.0].v_roll_std_3d == pytest.approx(statistics.stdev([1, 2, 4])) and a[1, 2.0].v_roll_max_3d == 4.0
    b = {r.v: r for r in out if r.g == "b"}
    assert b[100.0].v_cumsum_3d == 100.0 and b[5.0].v_cumsum_3d is None
    with pytest.raises(ValueError, match="frame"):
        lagged.features(df, ["v"], "g", frame="weeks")


def test_frequencies(spark):
    t = lambda *x: dt.datetime(2024, *x)
    df = spark.createDataFrame([("a", t(1, 31, 5), 1.0, 1.0), ("a", t(4, 1, 0), 2.0, 2.0), ("a", None, 9.0, 9.0), (None, t(1, 1, 7), 3.0, 3.0), (None, t(1, 1, 20), 5.0, 5.0)], "g string, ts timestamp, precip double, temp double")
    got = lambda **k: sorted(((r.g, r.ts, r.precip, r.temp) for r in temporal.resample(df, "ts", group=["g"], **k).collect()), key=str)
    assert got(freq="month") == sorted([("a", t(1, 1), 1.0, 1.0), ("a", t(2, 1), 0.0, None), ("a", t(3, 1), 0.0, None), ("a", t(4, 1), 2.0, 2.0), (None, t(1, 1), 8.0, 4.0)], key=str)
    assert got(freq="2 quarters", fill_bins=False)[0] == ("a", t(1, 1), 3.0, 1.5)
    assert got(freq="water year")[0] == ("a", dt.datetime(2023, 10, 1), 3.0, 1.5)
    assert {x[1].hour: x[2:] for x in got(freq="6 hours") if x[0] is None} == {6: (3.0, 3.0), 12: (0.0, None), 18: (5.0, 5.0)}
    assert got(freq="week", fill_bins=False)[0][1] == t(1, 29)
    for wrong in ("fortnight", "0 days", ""):
        with pytest.raises(ValueError, match="frequency"):
            temporal.resample(df, "ts", wrong, ["g"])


def test_days_of_a_zone(spark):
    """In Denver, 10 March 2024 has 23 hours and 3 November 25."""
    hours = spark.range(24 * 365).select((F.lit(dt.datetime(2024, 1, 1)) + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("ts"), F.lit(1.0).alias("n"))
    out = {r.ts: r.n for r in temporal.resample(hours, "ts", "day", rules={"n": "sum"}, zone="America/Denver").collect()}
    assert out[dt.datetime(2024, 3, 10)] == 23 and out[dt.datetime(2024, 11, 3)] == 25 and out[dt.datetime(2024, 7, 4)] == 24 and sum(out.values()) == 24 * 365


def test_odd_hours_in_utc(spark):
    local = ["2024-03-10 01:30:00", "2024-03-10 02:30:00", "2024-03-10 03:30:00", "2024-11-03 00:30:00", "2024-11-03 01:30:00", "2024-11-03 02:30:00"]
    df = spark.createDataFrame([(x,) for x in local], "x string").select("x", calendar.to_utc(F.col("x").cast("timestamp"), "America/Denver").alias("t"))
    got = {r.x: r.t.strftime("%d %H:%M") for r in df.collect()}
    assert got == {local[0]: "10 08:30", local[1]: "10 09:30", local[2]: "10 09:30", local[3]: "03 06:30", local[4]: "03 07:30", local[5]: "03 09:30"}


def test_files_of_different_layout(spark, tmp_path, caplog):
    day = [dt.datetime(2023, 1, 1)]
    put = lambda name, **c: pd.DataFrame({"datetime": day} | c).to_parquet(tmp_path / f"{name}_2023.parquet", coerce_timestamps="us")
    put("1_CO_SNTL", snow_depth=[300.0])
    put("2_CO_SNTL", SNWD=[250])
    put("3_CO_SNTL", SNWD=[70.5], WTEQ=[float("nan")])
    pd.DataFrame({"snow_depth": [1.0]}).to_parquet(tmp_path / "4_CO_SNTL_2023.parquet")  # no time
    (tmp_path / "5_CO_SNTL_2023.parquet").write_bytes(b"broken")
    (tmp_path / "6_CO_SNTL_2023.parquet").write_bytes(b"")
    out = {r.station_id: r for r in stations.read_station_files(spark, [str(tmp_path)], "metric").collect()}
    assert {k: (r.snow_depth_cm, r.swe_mm, r.quality_flag) for k, r in out.items()} == {"1:CO:SNTL": (300.0, None, "partial"), "2:CO:SNTL": (250.0, None, "partial"), "3:CO:SNTL": (70.5, None, "partial")}
    assert len([x for x in caplog.records if "left out" in x.message]) >= 2
    assert len(stations.by_layout(spark, [str(tmp_path)])) == 4
    with pytest.raises(ValueError, match="station file"):
        stations.read_station_files(spark, [str(tmp_path / "5_CO_SNTL_2023.parquet")])


def test_exact_quantiles(spark):
    rng = random.Random(2)
    rows = [("a", rng.gauss(0, 1)) for _ in range(3000)] + [("a", 0.25)] * 2000 + [("b", float(i)) for i in range(7)] + [(None, 1e300), (None, -1e300), ("n", None), ("n", float("nan"))] + [("c", 5.0)] * 500
    df = spark.createDataFrame(rows, "g string, x double")
    shares = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
    want = {r.g: r.q for r in df.withColumn("x", F.nanvl("x", F.lit(None))).groupBy("g").agg(F.percentile("x", F.array(*map(F.lit, shares))).alias("q")).collect()}
    for few in (1, 40, 100_000):
        got = {r.g: r.quantiles for r in exact_quantiles(df, "x", shares, ["g"], few=few, cells=16).collect()}
        assert got.keys() == want.keys() and all(got[k] == (pytest.approx(want[k]) if want[k] else want[k]) for k in want), few
    assert exact_quantiles(df.limit(0), "x", [0.5]).count() == 0


def test_outliers_of_null_groups_and_by_counting(spark):
    rows = [(g, float(i % 10)) for g in ("a", None) for i in range(60)] + [("a", 500.0), (None, -500.0), (None, None)]
    df = spark.createDataFrame(rows, "g string, temperature double")
    for few in (5, 100_000):
        out = quality.outliers(df, ["temperature"], group=["g"], few=few).collect()
        assert len(out) == len(rows) and {(r.g, r.temperature) for r in out if r.temperature_outlier_flag == quality.OUTLIER} == {("a", 500.0), (None, -500.0)}


def test_median_by_counting(spark):
    df = spark.range(1001).select((F.col("id") * F.col("id") % 997).cast("double").alias("y_pred"), F.lit(0.0).alias("y_true"))
    assert verification.residual_summary(df, few=10).first() == verification.residual_summary(df).first()


def test_folds_of_rows_in_order(spark):
    out = contiguous_folds(spark.range(10).select((9 - F.col("id")).alias("id")), ["id"], 4).orderBy("id").collect()
    assert [r.fold for r in out] == [0, 0, 0, 1, 1, 1, 2, 2, 3, 3]
    with pytest.raises(ValueError, match="fewer"):
        contiguous_folds(spark.range(3), ["id"], 4)


def test_holes_in_rasters(spark):
    cells = [(0, r, c, float(50 * c)) for r in range(7) for c in range(7) if c != 3] + [(1, r, c, None if (r, c) == (3, 3) else 1.0) for r in range(7) for c in range(7)]
    df = spark.createDataFrame(cells, "tile int, row int, col int, z double")
    slope = {(r.tile, r.row, r.col): r.slope for r in raster.gradients(df).collect()}
    steep = math.degrees(math.atan(50 / 30))
    assert all(slope[0, r, c] is None for r in range(7) for c in (2, 4)) and all(slope[0, r, c] == pytest.approx(steep) for r in range(7) for c in (0, 1, 5, 6))
    assert all(slope[1, *x] is None for x in ((3, 2), (3, 3), (3, 4), (2, 3), (4, 3))) and slope[1, 2, 2] == 0
    tpi = {(r.tile, r.row, r.col): r.tpi for r in raster.tpi(df, 1).collect()}
    assert all((tpi[1, r, c] is None) == (max(abs(r - 3), abs(c - 3)) <= 1) for r in range(7) for c in range(7))
    small = spark.createDataFrame([(0, r, c, 2.0) for r in range(2) for c in range(3)], "tile int, row int, col int, z double")
    assert all(r.tpi == 0 for r in raster.tpi(small, 5).collect()) and raster.tpi(small, 5).count() == 6  # reflected again and again


def test_elevation_at_points(spark):
    """Inside, at the last column, in the last corner, beside a hole, and outside."""
    dem = spark.createDataFrame([(0, r, c, float(10 * r + c)) for r in range(4) for c in range(4) if (r, c) != (0, 2)], "tile int, row int, col int, z double")
    rows = [(1, 0, 1.5, 1.25), (2, 0, 1.5, 3.5), (3, 0, 3.5, 3.5), (4, 0, 0.5, 1.5), (5, 0, 9.0, 1.0), (6, 7, 0.0, 0.0), (7, 0, 3.5, 0.5)]
    got = {r.point_id: r.z for r in raster.elevation_at(spark.createDataFrame(rows, "point_id int, tile int, y double, x double"), dem).collect()}
    assert got == {1: 16.25, 2: 15.5, 3: 33.0, 4: None, 5: None, 6: None, 7: 30.25}


def test_boosted_predicts_every_row(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, float("nan"), x]), rng.choice("ab"), 10.0 if x > 0.5 else x) for x in (rng.random() for _ in range(400))]
    df = spark.createDataFrame(rows, "x double, kind string, y double").withColumn("w", F.lit(None).cast("double"))
    model = models.boosted(df, ["x", "w"], "y", ["kind"], rows=0.9, columns="all", maxIter=3)
    new = df.unionByName(spark.createDataFrame([(None, "new", 1.0, None)], "x double, kind string, y double, w double"))
    out = models.predict(model, new)
    assert out.filter("prediction is not null").count() == 401 and not [c for c in out.columns if c.startswith("__")]
    weight = models.importance(model, ["x", "w", "kind"])
    assert weight["x"] > 0.5 and weight["w"] == 0 and sum(weight.values()) == pytest.approx(1)
    with pytest.raises(ValueError, match="no such columns"):
        models.predict(model, df.drop("w"))


def test_search_over_folds_of_stations(spark):
    df = models.synthetic(spark, 300, 3).withColumn("station", F.col("id") % 10)
    df = models.station_folds(df, "station", 3)
    space = {"maxDepth": models.Between(1, 4, whole=True), "stepSize": models.Between(0.01, 0.3, log=True), "maxIter": [2, 3]}
    best, history = models.searched(df, ["f0", "f1"], "target", space, n=3, fold="fold")
    rows = history.orderBy("trial").collect()
    assert len(rows) == 3 and [r.best for r in rows].count(True) == 1 and min(rows, key=lambda r: r.metric).best
    assert models.draws(space, 3) == models.draws(space, 3) and best.transform(df).count() == 300
    drawn = models.draws(space, 200)
    assert {d["maxDepth"] for d in drawn} == {1, 2, 3, 4} and all(0.01 <= d["stepSize"] <= 0.3 for d in drawn) and sum(d["stepSize"] < 0.055 for d in drawn) > 60
    with pytest.raises(ValueError, match="logarithmic"):
        models.draws({"a": models.Between(0, 1, log=True)}, 1)


def test_a_batch_that_comes_twice(spark, tmp_path):
    df = spark.createDataFrame([("a", dt.datetime(2024, 1, 1)), ("a", dt.datetime(2024, 1, 2))], "g string, run_time timestamp")
    write = jobs.in_folders(str(tmp_path / "t"), lambda d: jobs.freshness(d, ["g"]))
    for batch in (0, 1, 1, 1):
        write(df, batch)
    assert spark.read.parquet(str(tmp_path / "t")).agg(F.sum("n")).first()[0] == 4


def test_upserts_leave_nothing_beside(spark, tmp_path):
    place = lambda lat, z, t: spark.createDataFrame([(lat, 1.0, z, t)], "lat double, lon double, z double, fetch_time int")
    path = str(tmp_path / "terrain")
    for row in ((1.0, 10.0, 1), (1.0, 20.0, 2), (2.0, 5.0, 1), (1.0, 30.0, 0)):
        store.upsert_terrain(place(*row), path)
    assert sorted((r.lat, r.z) for r in spark.read.parquet(path).collect()) == [(1.0, 20.0), (2.0, 5.0)] and [x.name for x in tmp_path.iterdir()] == ["terrain"]
    run = spark.createDataFrame([(dt.datetime(2024, 1, 1), 3, 7, 1)], "run_time timestamp, forecast_hour int, location_id int, fetch_time int")
    for _ in range(2):
        store.upsert_forecasts(run, str(tmp_path / "forecasts"))
    assert spark.read.parquet(str(tmp_path / "forecasts")).count() == 1 and len(list(tmp_path.iterdir())) == 2


def test_own_limits_and_bands(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, h), float(v), 3.0) for h, v in enumerate((1, 2, 9, 20))], "ts timestamp, temperature double, other double")
    flags = quality.temporal(quality.physical(df, {"temperature": (0.0, 10.0), "other": (5.0, None)}), "ts", changes={"temperature": 5.0}).orderBy("ts").collect()
    assert [r.temperature_physical_flag for r in flags] == [0, 0, 0, quality.ABOVE] and all(r.other_physical_flag == quality.BELOW for r in flags)
    assert [r.temperature_temporal_flag for r in flags] == [0, 0, quality.TEMPORAL, quality.TEMPORAL]
    test = spark.createDataFrame([(1.0, 2.0, 3.0, dt.date(2024, 1, 1), 1, 100.0, 5.0), (9.0, 8.0, 3.0, dt.date(2024, 2, 1), 2, 900.0, 6.0)], "y_true double, y_pred double, y_base double, date date, station_id int, elevation double, humidity double")
    got = {(r.breakdown, r.bucket): r.n_samples for r in verification.breakdowns(test, elevation_edges=(0, 500, math.inf), storm_edges=(0, 5, math.inf)).collect()}
    assert got["elevation_band", "0-500"] == got["elevation_band", "500-+"] == got["storm", "5-+"] == 1 and got["month", "12"] == 0
    whole = verification.evaluate_holdout(test, ["humidity"])
    assert whole.keys() == {"metrics", "breakdowns", "residuals", "by_month", "by_station", "conditions", "trend"}
    assert whole["residuals"].first().mean == 0 and whole["by_month"].count() == whole["by_station"].count() == 2


def test_dates_and_grid(spark):
    assert [r.date.day for r in calendar.dates(spark, "2024-02-27", "2024-03-02", "2 days").collect()] == [27, 29, 2]
    grid = geo.point_grid(spark, {"south": 0, "north": 1, "west": -1, "east": 0.5}, 0.5).collect()
    assert sorted((r.lat, r.lon) for r in grid) == [(y / 2, x / 2) for y in range(3) for x in range(-2, 2)]


def test_p_of_known_t(spark):
    """Two-sided p of Student's t: table values of 5 % and 1 %."""
    for n, t, p in ((11, 2.228139, 0.05), (11, 3.169273, 0.01), (31, 2.042272, 0.05), (5, 2.776445, 0.05)):
        got = spark.createDataFrame([(t, n)], "t double, n long").select(verification.t_test_p("t", "n").alias("p")).first().p
        assert got == pytest.approx(p, abs=1e-5)


def test_p_of_known_critical_values(spark):
    """Student's t at two-sided 5 % and 1 %, from printed tables."""
    known = [(12.706, 1, 0.05), (2.571, 5, 0.05), (2.228, 10, 0.05), (3.169, 10, 0.01), (2.042, 30, 0.05), (1.980, 120, 0.05), (1.960, 10**7, 0.05), (-2.576, 10**7, 0.01), (0.0, 9, 1.0)]
    out = spark.createDataFrame([(t, df + 1, p) for t, df, p in known] + [(2.0, 1, None), (None, 9, None)], "t double, n long, p double").select("p", verification.t_test_p("t", "n").alias("got")).collect()
    for r in out:
        assert r.got == (r.p if r.p is None else pytest.approx(r.p, rel=2e-3))


def test_interval_ends_are_those_of_the_normal_law(spark):
    r = random.Random(5)
    e = [r.gauss(1.0, 3.0) for _ in range(4000)]
    df = spark.createDataFrame([(10.0, 10.0 + x) for x in e], "y_true double, y_pred double")
    got = {x.metric: x for x in verification.bootstrap(df).collect()}
    half = 1.96 * statistics.stdev(e) / math.sqrt(len(e))
    assert got["bias"].lower == pytest.approx(statistics.mean(e) - half, abs=0.12 * half) and got["bias"].upper == pytest.approx(statistics.mean(e) + half, abs=0.12 * half)
    a = [abs(x) for x in e]
    half = 1.96 * statistics.stdev(a) / math.sqrt(len(a))
    assert got["mae"].upper - got["mae"].lower == pytest.approx(2 * half, rel=0.12)


def test_collected_locations(spark, caplog):
    places = lambda *rows: (lambda s: s.createDataFrame([*rows], "station_id string, name string, lat double, lon double, elevation double, state string"))
    before = {k: dict(v) for k, v in stations.PROVIDERS.items()}
    stations.clear()
    try:
        none = stations.collect_all(spark)
        assert none.locations is None and none.issues == [] and not none.report.first().success and none.report.first().total == 0
        stations.register("station", "a", places(("1", "x", 1.0, 2.0, 100.0, "CO"), ("2", "y", None, 2.0, 300.0, "UT"), ("3", None, 1.0, 2.0, 5.0, None)))
        stations.register("resort", "b", places(("9", "z", 1.0, 2.0, 50.0, None)))
        whole = stations.collect_all(spark, min_elevation=60.0)
        r = whole.report.first()
        assert (r.total, r.without_place, r.by_kind, r.by_state, r.issues, r.success) == (3, 1, {"station": 2, "resort": 1}, {"CO": 1, "UT": 1, "unknown": 1}, [], True)
        assert stations.extraction_points(whole.locations).count() == 2
        boom = lambda s: s.range(3).select(F.raise_error(F.lit("no access")).cast("string").alias("station_id"), F.lit(1.0).alias("lat"), F.lit(1.0).alias("lon"), F.lit(1.0).alias("elevation"))
        stations.register("station", "late", boom)  # plans well, fails when read
        stations.register("resort", "early", lambda s: 1 / 0)
        some = stations.collect_all(spark)
        assert len(some.issues) == 2 and "station provider late" in some.issues[0] and "resort provider early: division by zero" == some.issues[1]
        r = some.report.first()
        assert (r.total, len(r.issues), r.success) == (4, 2, False) and stations.collect_registered(spark, "station").count() == 3
    finally:
        stations.clear()
        for k, v in before.items():
            stations.PROVIDERS[k].update(v)


def test_status_without_a_normal(spark):
    rows = [(0.0, 0.0, "Normal"), (1.0, 0.0, "Normal"), (-1.0, 0.0, "Well Below Normal"), (None, 0.0, "Well Below Normal"), (3.0, 2.0, "Above Normal"), (-3.0, -2.0, "Normal"), (1.0, None, "Well Below Normal")]
    d = spark.createDataFrame(rows, "v double, n double, want string")
    assert all(r.got == r.want for r in d.select("want", snow.quotient_status(F.col("v"), F.col("n")).alias("got")).collect())


def test_amounts_that_are_nearly_halves(spark):
    d = spark.range(1).select(F.lit("r").alias("request_id"), *[F.lit(x).cast("double").alias(c) for c, x in {"hrrr_temp_k": None, "hrrr_precip_mm": None, "hrrr_depth_m": None, "hrrr_categorical": None, "nbm_temp_k": 270.0, "nbm_new_m": 1.23 / 10, "nbm_depth_m": 1.23, "last_depth_m": None, "slope": 40.0, "aspect": 180.0}.items()])
    r = forecast.predicted(d).first()
    assert (r.new_snow_cm, r.ci_lower, r.ci_upper) == (11.1, 6.2, 16.0)  # 6.1499999999999995 is a half to 15 decimals


def test_draws_are_those_of_cumulative_probabilities():
    import numpy as np

    h = np.random.default_rng(3).integers(0, 2**64, (50, 20_000), dtype=np.uint64)
    u = h * np.uint64(0xBF58476D1CE4E5B9)
    u = (u ^ (u >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    u = ((u ^ (u >> np.uint64(29))) >> np.uint64(11)).astype(float) / 2.0**53
    want, p = np.zeros(u.shape), math.exp(-1)
    c = p
    for j in range(1, 12):
        want += u > c
        p /= j
        c += p
    got = verification.poisson_draws(h)
    assert (got == want).all() and got.mean() == pytest.approx(1, abs=0.01) and got.var() == pytest.approx(1, abs=0.01)


def test_equal_rows_train_as_one(spark, monkeypatch):
    """Trees see each combination of features and target once, and models are those of all rows."""
    draw = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)) * F.pmod(F.xxhash64("id", F.lit(seed + 10)), F.lit(2))  # noqa: E731  0 is more frequent
    df = spark.range(12000).select("id", draw(5, 1).cast("double").alias("x"), F.nullif(draw(4, 2).cast("double"), F.lit(2.0)).alias("w"), F.concat(F.lit("k"), draw(3, 3).cast("string")).alias("kind"), (F.col("id") % 2).alias("fold"), draw(3, 4).alias("noise"))
    df = df.withColumn("y", F.col("x") ** 2 + F.coalesce("w", F.lit(7.0)) + F.when(F.col("kind") == "k1", 5.0).otherwise(0.0) + F.col("noise")).drop("noise", "id")
    seen, fit = [], models.GBTRegressor._fit
    monkeypatch.setattr(models.GBTRegressor, "_fit", lambda self, rows: seen.append(rows.count()) or fit(self, rows))
    predicted = lambda m: [r.prediction for r in m.transform(df).select("x", "w", "kind", "prediction").distinct().orderBy("x", "w", "kind").collect()]
    got = predicted(models.boosted(df, ["x", "w"], "y", ["kind"], maxIter=3))
    assert seen[0] == df.select("x", "w", "kind", "y").distinct().count() < 1200
    assert got == pytest.approx(predicted(models.boosted_pipeline(["x", "w"], "y", ["kind"], maxIter=3).fit(df)))
    plain = df.filter("w IS NOT NULL").drop("kind")
    rows = models.counted(plain, ["x", "w", "fold", "y"])
    assert rows.agg(F.sum(models.ROWS)).first()[0] == plain.count() > 10 * rows.count()
    one, all_ = (models.ridge(d, ["x", "w"], "y").stages[-1] for d in (rows, plain))
    assert [*one.coefficients, one.intercept] == pytest.approx([*all_.coefficients, all_.intercept])
    meta = [models.stacked(d, ["x", "w"], "y", "fold", {"ridge": models.ridge, "trees": models.fitter("boosted", maxIter=2)})[0].stages[-1].coefficients.toArray().tolist() for d in (rows, plain)]
    assert meta[0] == pytest.approx(meta[1])
    with pytest.raises(ValueError, match="single rows"):
        models.boosted(rows, ["x"], "y", rows=0.5)


def test_names_with_dots_train(spark):
    """Features of any name are counted."""
    df = spark.range(60).select((F.col("id") % 4).cast("double").alias("a.b"), (F.col("id") % 4 * 2.0).alias("y"))
    assert sorted(tuple(r) for r in models.counted(df, ["a.b", "y"]).collect()) == [(float(i), i * 2.0, 15.0) for i in range(4)]
    assert {r.y: round(r.prediction, 3) for r in models.boosted(df, ["a.b"], "y", maxIter=1).transform(df).collect()} == {0.0: 0.0, 2.0: 2.0, 4.0: 4.0, 6.0: 6.0}
