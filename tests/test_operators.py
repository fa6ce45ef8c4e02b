"""Exact values and invariants on small frames."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from nivalis import models
from nivalis.functions import atmosphere, calendar, geo, snow, terrain
from nivalis.operators import forecast, lagged, quality, raster, spatial, temporal, verification
from nivalis.session import no_nan
from nivalis.sources import resorts, stations, store


def one(df):
    return df.first().asDict()


def day(n):
    return dt.date(2023, 1, n)


def test_nan_becomes_null(spark):
    assert [r[0] for r in no_nan(spark.createDataFrame([(1.0,), (float("nan"),)], "x double")).collect()] == [1.0, None]


def test_daily_mean_never_interpolates(spark):
    rows = [(dt.datetime(2023, 1, 1, h), t) for h, t in ((0, 5.0), (1, 6.0), (3, 8.0))]
    out = one(temporal.resample_daily(spark.createDataFrame(rows, "datetime timestamp, temp_avg_c double"), "datetime"))
    assert out == {"date": day(1), "temp_avg_c": pytest.approx(19 / 3)}


def test_rules_by_longest_name():
    assert temporal.rule_for("temp_max") == "max" and temporal.rule_for("temp_max", pick="first") == "mean"
    assert temporal.rule_for("snow_depth_cm") == "mean" and temporal.rule_for("unknown") == "mean" and temporal.rule_for("x", {"x": "sum"}) == "sum"


def test_fill_bins(spark):
    rows = [(dt.datetime(2023, 1, 1), 1.0, 2.0), (dt.datetime(2023, 1, 3), 3.0, 4.0)]
    grouped = temporal.resample_daily(spark.createDataFrame([("a", *r) for r in rows], "station_id string, datetime timestamp, temp double, precip double"), "datetime", ["station_id"], fill_bins=True)
    assert sorted((r.date, r.temp, r.precip) for r in grouped.collect())[1] == (day(2), None, 0.0)


def test_align_and_coverage(spark):
    df = spark.createDataFrame([("s", day(1), 5.0), ("s", day(3), 3.0), ("s", day(5), -2.0)], "station_id string, date date, temp_avg_c double")
    out = sorted((r.date, r.temp_avg_c) for r in temporal.align(df, "date", "2023-01-01", "2023-01-05", ["station_id"]).collect())
    assert [v for _, v in out] == [5.0, None, 3.0, None, -2.0]
    c = one(temporal.coverage(df, "date", "2023-01-01", "2023-01-05", ["station_id"]))
    assert (c["present_days"], c["missing_days"], c["coverage_pct"], len(c["gaps"])) == (3, 2, 60.0, 2)


def test_lags_stay_in_their_group(spark):
    df = spark.createDataFrame([("a", day(i), float(i)) for i in range(1, 8)] + [("b", day(i), 100.0 + i) for i in range(1, 8)], "station_id string, date date, value double")
    out = {(r.station_id, r.date.day): r for r in lagged.features(df, ["value"], "station_id").collect()}
    assert out["b", 1].value_lag_1d is None and out["a", 3].value_roll_mean_3d == 2.0 and out["a", 7].value_cumsum_7d == 28.0 and out["a", 1].value_roll_std_3d is None
    assert set(lagged.feature_names(["value"])) == {c for c in lagged.features(df, ["value"], "station_id").columns if c not in df.columns}
    with pytest.raises(ValueError):
        lagged.features(df, ["nothing"], "station_id")


def test_quality_flags(spark):
    rows = [(dt.datetime(2023, 1, 1, i), t, s) for i, (t, s) in enumerate(((10.0, 100.0), (12.0, 105.0), (50.5, 200.0), (15.0, -10.0), (None, 115.0)))]
    df = spark.createDataFrame(rows, "datetime timestamp, temperature double, snow_depth double")
    t = [r.temperature_temporal_flag for r in quality.temporal(df, "datetime").orderBy("datetime").collect()]
    p = [(r.temperature_physical_flag, r.snow_depth_physical_flag) for r in quality.physical(df).orderBy("datetime").collect()]
    assert t == [0, 0, 16, 16, 1] and p == [(0, 0), (0, 0), (4, 0), (0, 2), (1, 0)]
    flagged = quality.flagged(df, "datetime")
    assert quality.valid_only(flagged).count() < df.count() and [c for c in df.columns if c in quality.valid_only(flagged).columns] == df.columns
    r = one(quality.report(flagged, ["temperature", "snow_depth"]))
    assert r["total"] == 5 and r["physical_violations"] == 2 and not r["acceptable"]


def test_outliers(spark):
    df = spark.createDataFrame([(10.7 + 0.1 * (i % 5),) for i in range(20)] + [(100.0,), (-50.0,), (None,)], "temperature double")
    flags = {r.temperature: r.temperature_outlier_flag for r in quality.outliers(df, ["temperature"]).collect()}
    assert flags[100.0] == flags[-50.0] == 8 and flags[None] == 1 and sum(flags.values()) == 17
    few = spark.createDataFrame([(1.0,), (99.0,)], "temperature double")
    assert all(r.temperature_outlier_flag == 0 for r in quality.outliers(few, ["temperature"]).collect())


def test_planes(spark):
    cells = [(0, r, c, 1000.0 + 30.0 * r) for r in range(10) for c in range(10)]
    out = raster.gradients(spark.createDataFrame(cells, "tile int, row int, col int, z double")).collect()
    assert all(abs(r.slope - 45) < 1e-9 for r in out)
    flat = spark.createDataFrame([(0, r, c, 1000.0) for r in range(10) for c in range(10)], "tile int, row int, col int, z double")
    assert all(r.roughness == 0 for r in raster.roughness(flat).collect()) and all(abs(r.tpi) < 1e-9 for r in raster.tpi(flat).collect()) and raster.tpi(flat).count() == 100


def test_places(spark):
    d = one(spark.range(1).select(geo.haversine_km(F.lit(39.8), F.lit(-105.78), F.lit(39.68), F.lit(-105.9)).alias("km")))
    assert 16 < d["km"] < 17.5
    places = spark.createDataFrame([(1, 39.64, -106.37), (2, 45.0, -100.0), (3, None, None)], "id int, lat double, lon double")
    st = spark.createDataFrame([("x", 39.8, -105.78), ("y", 39.68, -105.9), ("z", 39.65, -106.3)], "station_id string, lat double, lon double")
    out = {r.place: r.station for r in spatial.nearest_station(places, st, 60.0).collect()}
    assert out == {1: "z", 2: None, 3: None}


def test_bilinear_outside_is_null(spark):
    cells = spark.createDataFrame([(float(a), float(b), a + 10.0 * b) for a in range(3) for b in range(3)], "lat double, lon double, v double")
    pts = spark.createDataFrame([(1, 0.5, 1.5), (2, 9.0, 1.0), (3, 2.0, 2.0)], "point_id int, lat double, lon double")
    assert {r.point_id: r.v for r in spatial.bilinear(pts, cells, "v").collect()} == {1: 15.5, 2: None, 3: 22.0}


def test_snow_rules(spark):
    c = lambda x: F.lit(x)
    out = one(spark.range(1).select(snow.slr(c(15.0), c(10.0)).alias("a"), snow.slr(c(10.0), c(0.0)).alias("b"), snow.snow_quality(c(15.0), c(-8.0), c("stable")).alias("q"), snow.snow_quality(c(6.0), c(2.0), c("warming")).alias("i"), snow.snow_line(c(5.0), c(2000.0), c(3000.0)).alias("line"), snow.freshness(c(None).cast("double")).alias("f"), terrain.cardinal(c(350.0)).alias("n"), snow.nbm_hour(c(100)).alias("h")))
    assert out == {"a": 15.0, "b": 10.0, "q": "powder", "i": "icy", "line": pytest.approx(2923.0769), "f": "Unknown", "n": "N", "h": 102}


def test_atmosphere_keeps_null(spark):
    df = spark.createDataFrame([(None, 270.0, 1.0, 1.0), (273.15, 273.15, 0.0, 0.0)], "t2m double, d2m double, u10 double, v10 double")
    a, b = atmosphere.all_features(df).collect()
    assert a.relative_humidity is None and b.relative_humidity == 100.0 and b.wind_direction == 0.0 and b.wind_chill == 0.0


def test_water_year(spark):
    df = spark.createDataFrame([("2023-10-01",), ("2024-09-30",)], "datetime string")
    assert [(r.water_year, r.day_of_water_year) for r in calendar.all_features(df).collect()] == [(2024, 1), (2024, 366)]


def test_events_and_summary(spark):
    new = [0.0, 2.0, 20.0, 25.0, 3.0, None, 0.0]
    df = spark.createDataFrame([(1, dt.date(2024, 1, 15 + i), v, 100.0) for i, v in enumerate(new)], "location_id int, date date, new_snow_cm double, snow_depth_cm double")
    e = one(forecast.snow_events(df, ["location_id"]))
    assert (e["days"], e["total_cm"], e["intensity"]) == (2, 45.0, "very heavy")
    assert one(forecast.summary(df, ["location_id"]))["summary"] == "Very heavy snow expected Wednesday-Thursday (45cm). Good base conditions."


def test_fallback_chain(spark):
    s = "request_id int, hrrr_temp_k double, hrrr_precip_mm double, hrrr_depth_m double, hrrr_categorical double, nbm_temp_k double, nbm_new_m double, nbm_depth_m double, last_depth_m double, slope double, aspect double"
    rows = [(1, 263.15, 10.0, 1.0, 1.0, None, None, None, None, 35.0, 0.0), (2, None, None, None, None, 270.0, 0.1, 0.5, None, None, None), (3, None, None, None, None, None, None, None, 0.7, None, None), (4, *[None] * 10)]
    out = {r.request_id: r for r in forecast.predicted(spark.createDataFrame(rows, s)).collect()}
    assert (out[1].source, out[1].snow_depth_cm, out[1].new_snow_cm, out[1].probability) == ("HRRR", 105.0, 18.0, 0.9)
    assert (out[2].source, out[2].new_snow_cm, out[2].probability, out[2].ci_lower, out[2].ci_upper) == ("NBM", 10.0, 0.85, 6.0, 14.0)
    assert (out[3].source, out[3].snow_depth_cm, out[3].ci_upper) == ("persistence", 70.0, 5.0) and (out[4].source, out[4].probability) == ("none", 0.01)


def test_metrics_edges(spark):
    none = one(verification.by_group(spark.createDataFrame([(None, 1.0)], "y_true double, y_pred double")))
    assert none["rmse"] is None and none["f1"] is None and none["n_samples"] == 1
    some = one(verification.by_group(spark.createDataFrame([(3.0, 3.0), (0.0, 4.0), (5.0, 1.0)], "y_true double, y_pred double")))
    assert some["precision"] == some["recall"] == some["f1"] == 0.5


def test_t_test(spark):
    rows = [(float(i % 7), float(i % 7) + 0.1 * (i % 3), float(i % 7) + 1.0 + 0.1 * (i % 5)) for i in range(50)]
    out = one(verification.significance(spark.createDataFrame(rows, "y_true double, a double, b double"), "a", "b"))
    assert out["significant"] and out["better"] == "a" and out["p"] < 1e-6
    assert verification._beta_tail(1, 1, 0.3) == pytest.approx(0.3) and verification._beta_tail(4.5, 0.5, 9 / (9 + 2.262157**2)) == pytest.approx(0.05, abs=1e-5)


def test_nearest_cell_is_nearest_of_all(spark):
    import random

    rng = random.Random(6)
    cells = [(i, rng.uniform(30, 50), rng.uniform(-125, -100)) for i in range(60)] + [(60, -0.01, 1.01), (61, 2.99, 2.99)]
    # between cells, off the grid, and one whose nearest cell (60) is beyond the nine buckets while a farther one (61) is in them
    points = [(i, rng.uniform(-60, 80), rng.uniform(-179, 179)) for i in range(60)] + [(60, 1.01, 1.01), (61, None, 5.0), (62, 90.0, 0.0)]
    got = spatial.nearest_cell_map(spark.createDataFrame(points, "point_id long, lat double, lon double"), spark.createDataFrame(cells, "cell_id long, lat double, lon double"))
    want = {i: min((math.sqrt((a - c) ** 2 + (b % 360 - d % 360) ** 2), j) for j, c, d in cells)[1] for i, a, b in points if a is not None}
    assert {r.point_id: r.cell_id for r in got.collect()} == want and got.count() == len(want)


def test_bootstrap_covers(spark):
    df = spark.range(2000).select((F.col("id") % 50).cast("double").alias("y_true"), (F.col("id") % 50 + F.col("id") % 11 - 5).cast("double").alias("y_pred"), "id")
    ci = {r.metric: r for r in verification.bootstrap(df, 200, row_id=["id"]).collect()}
    assert ci["rmse"].lower < math.sqrt(10) < ci["rmse"].upper and ci["bias"].lower < 0.01 and ci["bias"].upper > -0.01


def test_model_queries_run_whole(spark, monkeypatch):
    from nivalis.queries import QUERIES

    sf, seen = "/root/testdata/sf0.001", {}
    boot, trees = verification.bootstrap, models.boosted
    monkeypatch.setattr(verification, "bootstrap", lambda df, n=1000, **a: seen.update(n=n) or boot(df, n, **a))
    monkeypatch.setattr(models, "boosted", lambda *a, **k: seen.update(k) or trees(*a, **k))
    assert QUERIES["a17_bootstrap"](spark, sf).count() == 4 and seen["n"] == 1000
    assert QUERIES["m2_boosted_trees"](spark, sf).count() == 1 and seen["maxIter"] == 1000 and seen["validation"]
    rows = {r.model: r for r in QUERIES["m4_stacking"](spark, sf).collect()}
    assert set(rows) == {"ridge", "boosted", "stacked"} and rows["stacked"].rmse < 1.2 * min(r.rmse for r in rows.values())


def test_ridge_is_closed_form(spark):
    import numpy as np

    rng = np.random.default_rng(42)
    x = rng.normal(size=(100, 2))
    y = 3 * x[:, 0] + 2 * x[:, 1] + rng.normal(0, 0.1, 100)
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y, strict=True)], "f1 double, f2 double, target double")
    z = (x - x.mean(0)) / x.std(0)
    want = np.linalg.solve(z.T @ z + np.eye(2), z.T @ (y - y.mean())) / x.std(0)
    assert np.allclose(models.ridge(df, ["f1", "f2"], "target").stages[-1].coefficients.toArray(), want, atol=1e-6)


def test_ensemble_drops_broken_models(spark):
    df = spark.createDataFrame([(1.0, 3.0, None), (2.0, 4.0, 1.0)], "a double, b double, c double")
    assert [r.prediction for r in models.ensemble(df, {"a": 1.0, "b": 1.0, "c": 1.0}).collect()] == [2.0, 3.0]
    assert [r.prediction for r in models.ensemble(df, {"a": 1.0, "b": 1.0}, "median").collect()] == [2.0, 3.0]


def test_search(spark):
    df = models.synthetic(spark, 200, 3)
    best, history = models.search(df, ["f0", "f1"], "target", {"maxDepth": [2, 3], "maxIter": [2]})
    assert len(history) == 2 and best.transform(df).count() == 200


def test_station_files(spark, tmp_path):
    rows = [(dt.datetime(2023, 1, 1), 50.0, 15.0, -5.0), (dt.datetime(2023, 1, 2), 52.0, 16.0, -3.0), (dt.datetime(2023, 1, 3), None, 14.0, -7.0)]
    p = str(tmp_path / "1050_CO_SNTL_2023-01-01_2023-01-03.parquet")
    spark.createDataFrame(rows, "datetime timestamp, SNOWDEPTH double, SWE double, TEMPAVG double").toPandas().to_parquet(p, coerce_timestamps="us")
    out = stations.read_station_files(spark, [p], "metric").orderBy("datetime").collect()
    assert [(r.station_id, r.snow_depth_cm, r.quality_flag) for r in out] == [("1050:CO:SNTL", 50.0, "good"), ("1050:CO:SNTL", 52.0, "good"), ("1050:CO:SNTL", None, "partial")]


def test_daily_lines(spark, tmp_path):
    values = ["  100   ", "  110 G ", "-9999   ", "  120 S "] + ["-9999   "] * 27
    feb = ["   10   "] * 31
    (tmp_path / "a.dly").write_text("USC00010008202301TMAX" + "".join(values) + "\nUSC00010008202302PRCP" + "".join(feb) + "\nbad\n")
    out = stations.read_daily(spark, [str(tmp_path / "a.dly")], "2023-01-01", "2023-12-31")
    assert stations.wide(out).count() == 29
    out = out.collect()
    assert sum(r.element == "TMAX" for r in out) == 1 and sum(r.element == "PRCP" for r in out) == 28


def test_geojson(spark, tmp_path):
    p = tmp_path / "a.geojson"
    p.write_text('{"type":"FeatureCollection","features":[{"geometry":{"type":"Polygon","coordinates":[[[-106,39],[-105,39],[-105,40],[-106,40],[-106,39]]]},"properties":{"name":"A","sources":[{"country":"US"}]}},{"geometry":null,"properties":{"name":"B"}},{"geometry":{"type":"Point","coordinates":[-105,39]},"properties":{}}]}')
    (r,) = resorts.ski_areas(resorts.read_features(spark, str(p))).collect()
    assert (r.name, round(r.lat, 6), round(r.lon, 6), r.country) == ("A", 39.5, -105.5, "US")


def test_upsert(spark, tmp_path):
    path = str(tmp_path / "f")
    t = dt.datetime(2023, 1, 1)
    rows = lambda v, n: spark.createDataFrame([(t, n, i, t + dt.timedelta(hours=int(v)), float(v)) for i in range(3)], "run_time timestamp, forecast_hour int, location_id int, fetch_time timestamp, depth double")
    store.upsert_forecasts(rows(1, 6), path)
    store.upsert_forecasts(rows(2, 6), path)
    store.upsert_forecasts(rows(3, 12), path)
    out = spark.read.parquet(path)
    assert sorted((r.forecast_hour, r.depth) for r in out.collect()) == [(6, 2.0)] * 3 + [(12, 3.0)] * 3
    assert store.retained(out, F.lit(dt.datetime(2023, 2, 1))).count() == 0
    assert spark.createDataFrame(store.SKI_AREAS, "name string, lat double, lon double, state string, base int").count() == 22


def test_stations_around_the_earth(spark):
    import random

    rng = random.Random(8)
    schema = "id long, lat double, lon double"
    places = [(i, rng.choice([-89.7, 89.9, 0.0, 60.0]) + rng.uniform(-0.09, 0.09), rng.choice([-180, -179.5, 179.8, 0.1, 90]) + rng.uniform(0, 0.2)) for i in range(60)]
    stations = [(i, lat + rng.uniform(-0.1, 0.1) * (abs(lat) < 89), ((lon + rng.uniform(-0.6, 0.6) + 180) % 360) - 180) for i, lat, lon in places]

    def km(a, b):
        f, g = math.radians(a[1]), math.radians(b[1])
        x = math.sin((g - f) / 2) ** 2 + math.cos(f) * math.cos(g) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * 6371 * math.asin(math.sqrt(min(x, 1)))

    got = spatial.near_stations(spark.createDataFrame(places, schema), spark.createDataFrame(stations, schema), 60.0, station_id="id").collect()
    want = {(a[0], b[0]) for a in places for b in stations if km(a, b) <= 60}
    assert {(r.place, r.station) for r in got} == want and len(got) == len(want)


def test_axis_search_is_exact(spark):
    import random

    rng = random.Random(9)
    axis = sorted({round(rng.uniform(-50, 50), 2) for _ in range(40)})
    cells = spark.createDataFrame([(a, 5.0, a) for a in axis], "latitude double, longitude double, v double")
    points = spark.createDataFrame([(i, x, 4.0) for i, x in enumerate([-80.0, 80.0, axis[3], *(rng.uniform(-60, 60) for _ in range(80))])], "point_id long, lat double, lon double")
    for r in spatial.nearest_cells(points, cells).collect():
        assert abs(r.lat - r.v) == min(abs(r.lat - a) for a in axis)
    with pytest.raises(ValueError):
        spatial.nearest_cells(points, cells.withColumnRenamed("latitude", "north"))


def test_validation_of_bad_frames(spark):
    from nivalis.operators import validation

    empty = spark.createDataFrame([], "station_id string, datetime timestamp, snow_depth_cm double, swe_mm double, temp_avg_c double, quality_flag string")
    r = validation.snotel(empty).first()
    assert not r.valid and r.issues == ["no rows", "missing"] and r.missing_pct == 100
    r = validation.snotel(empty.drop("quality_flag").unionByName(spark.createDataFrame([("a", None, 3000.0, 1.0, 0.0)], "station_id string, datetime timestamp, snow_depth_cm double, swe_mm double, temp_avg_c double"))).first()
    assert not r.valid and r.issues == ["no column quality_flag", "depth_range"]
    d = spark.createDataFrame([(1.0, 100.0)], "elevation double, slope double")
    assert validation.terrain(d).first().issues == ["outliers"] and validation.terrain(spark.createDataFrame([(1,)], "tile int")).first().valid
    with pytest.raises(ValueError, match="outliers"):
        validation.run(lambda: d, lambda x: x, validation.terrain, strict=True)


def test_bootstrap_draws_equal_rows_apart(spark):
    rows = [(1.0, 2.0)] * 50 + [(1.0, 0.0)] * 50  # two kinds of rows
    out = {r.metric: r for r in verification.bootstrap(spark.createDataFrame(rows, "y_true double, y_pred double"), 400).collect()}
    assert out["bias"].estimate == 0 and out["rmse"].estimate == 1
    assert 0.1 < out["bias"].upper < 0.35  # 1.96 / sqrt(100) is 0.196; rows drawn together would give far more


def test_stacking_fills_and_weighs(spark):
    from nivalis import models

    d = spark.range(300).select((F.col("id") % 17).cast("double").alias("a"), (F.col("id") % 3).alias("fold"), (F.col("id") % 17 * 2.0 + F.col("id") % 5).alias("y"))
    meta, base, oof = models.stacked(d, ["a"], "y", "fold", {"one": models.fitter("ridge", alpha=1.0), "two": models.fitter("boosted", maxIter=3)}, with_features=True)
    assert meta.stages[0].getInputCols() == ["one", "two", "a"] and oof.count() == 300
    w = {r.model: r.weight for r in models.meta_weights(spark, meta, ["one", "two"]).collect()}
    assert sum(w.values()) == pytest.approx(1)
    holes = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (3.0,)], "p double")
    assert [r.p for r in models.filled(holes, ["p"]).collect()] == [1.0, 2.0, 2.0, 3.0]
    with pytest.raises(ValueError):
        models.fitter("absent")


def test_search_with_an_objective_and_saved_model(spark, tmp_path):
    from nivalis import models

    d = spark.range(200).select((F.col("id") % 13).cast("double").alias("a"), (F.col("id") % 13 * 3.0).alias("y"))
    worst = models.Objective(lambda y, p: F.max(F.abs(y - p)), "y")
    best, history = models.search(d, ["a"], "y", {"maxDepth": [1, 4]}, worst)
    assert len(history) == 2 and best.stages[-1].getMaxDepth() == 4
    models.save_model(spark, best, str(tmp_path / "m"), ["a"], {"maxDepth": 4})
    model, features, params = models.load_model(spark, str(tmp_path / "m"))
    assert features == ["a"] and params == {"maxDepth": 4} and model.transform(d).count() == 200
    assert models.importance_table(spark, best, ["a"]).first().feature == "a"


def test_resample_and_z_scores(spark):
    h = spark.range(48).select(F.lit("s").alias("station"), (F.timestamp_seconds(F.col("id") * 3600)).alias("ts"), F.col("id").cast("double").alias("temp"))
    out = temporal.resample(h, "ts", "12 hours", ["station"]).orderBy("ts").collect()
    assert [r.temp for r in out] == [5.5, 17.5, 29.5, 41.5]
    z = lagged.sequences(h, ["temp"], 2, "station", "ts", "temp", z_score=True).orderBy("ts").collect()
    assert z[0].target == 1.0 and z[-1].sequence[-1]["temp"] == pytest.approx((47 - 23.5) / math.sqrt((48**2 - 1) / 12))


def test_running_totals_and_logs(spark, tmp_path):
    import datetime as dt

    from nivalis import models
    from nivalis.sources import stations, store

    rows = [(dt.datetime(2024, 1, 1, h), 1.0, 2.0, float(h * h)) for h in range(1, 5)] + [(dt.datetime(2024, 1, 2, 1), 1.0, 2.0, 7.0)]
    d = spark.createDataFrame(rows, "time timestamp, lat double, lon double, tp double")
    out = {str(r.date): r.tp for r in temporal.grid_daily(d, ["tp"], deaccumulate=True).collect()}
    assert out == {"2024-01-01": 16.0, "2024-01-02": 7.0}
    for status in ("success", "error"):
        store.log_row(spark, str(tmp_path / "log"), "hrrr", "2024-01-01 00:00:00", status, 3, 10, None)
    r = store.outcomes(spark.read.parquet(str(tmp_path / "log"))).first()
    assert (r.total, r.success, r.failed, r.records) == (2, 1, 1, 6)
    assert models.load_data(spark, None, 50).count() == 50
    d.write.parquet(str(tmp_path / "rows"))
    assert models.load_data(spark, str(tmp_path / "rows")).count() == 5
    with pytest.raises(ValueError):
        store.load(spark, str(tmp_path / "rows"), ["absent"])
    stations.clear()
    with pytest.raises(ValueError):
        stations.collect_registered(spark, "resort")
    assert [r.s for r in spark.createDataFrame([("1050:CO:SNTL",), ("x",)], "i string").select(stations.state_of(F.col("i")).alias("s")).collect()] == ["CO", None]
