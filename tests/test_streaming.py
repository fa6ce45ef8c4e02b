"""Streams give what the batch operators give, once a late row has pushed the watermark."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from nivalis.streaming import jobs


@pytest.fixture
def source(spark, tmp_path):
    start = dt.datetime(2023, 1, 1)
    rows = [(s, start + dt.timedelta(hours=6 * i), float((i * 7 + s) % 30)) for s in (1, 2) for i in range(40)]
    late = [(s, start + dt.timedelta(days=60), 25.0) for s in (1, 2)]
    schema = "station_id int, ts timestamp, temperature double"
    batch = spark.createDataFrame(rows, schema)
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.createDataFrame(late, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return batch, spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def run(spark, df, name, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
    q.processAllAvailable()
    q.processAllAvailable()
    q.stop()
    return spark.sql(f"SELECT * FROM {name}")


def test_daily(spark, source, tmp_path):
    batch, stream = source
    out = run(spark, jobs.daily(stream, "ts", ["station_id"], [F.sum("temperature").alias("t")]), "st1", tmp_path)
    want = batch.groupBy("station_id", F.col("ts").cast("date").alias("date")).agg(F.sum("temperature").alias("t"))
    assert sorted(map(tuple, out.filter("date < '2023-02-01'").collect())) == sorted(map(tuple, want.collect()))


def test_rolling_and_events(spark, source, tmp_path):
    batch, stream = source
    out = run(spark, jobs.rolling(stream, "ts", ["station_id"], [F.sum("temperature").alias("t")], 7), "st2", tmp_path)
    row = {(r.station_id, r.date): r.t for r in out.collect()}
    day = dt.date(2023, 1, 8)
    want = batch.filter("ts >= '2023-01-02' and ts < '2023-01-09' and station_id = 1").agg(F.sum("temperature")).first()[0]
    assert row[1, day] == want
    ev = run(spark, jobs.events(stream, "ts", ["station_id"], "temperature", 20.0), "st3", tmp_path)
    assert ev.agg(F.sum("n")).first()[0] == batch.filter("temperature >= 20").count()


def test_matched(spark, source, tmp_path):
    batch, stream = source
    f = stream.select(F.col("station_id").alias("location_id"), F.col("ts").alias("valid_time"), F.col("temperature").alias("said"))
    o = stream.select(F.col("station_id").alias("location_id"), F.col("ts").alias("datetime"), F.col("temperature").alias("seen"))
    out = run(spark, jobs.matched(f, o, 5), "st7", tmp_path)
    assert out.filter("valid_time < '2023-02-01'").count() == batch.count()


def test_each_batch(spark, source, tmp_path):
    _, stream = source
    seen = []
    q = jobs.each_batch(stream.withColumnRenamed("ts", "run_time"), lambda df: seen.extend(jobs.freshness(df, ["station_id"]).collect()), str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sum(r.n for r in seen) == 82


def test_jumps(spark, source, tmp_path):
    from nivalis.operators import quality

    batch, stream = source
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    out = run(spark, jobs.jumps(stream, "ts", "station_id", "temperature", 2.0), "st4", tmp_path)
    want = quality.temporal(batch, "ts", ["station_id"], {"temperature": 2.0})
    a = sorted((r.station_id, r.ts, r.flag) for r in out.filter("ts < '2023-02-01'").collect())
    assert a == sorted((r.station_id, r.ts, r.temperature_temporal_flag) for r in want.collect())


def test_jumps_in_order_and_expiry(spark, tmp_path):
    """Rows of a file come in any order; a row a batch late is put in order; a silent group's state expires."""
    start = dt.datetime(2023, 1, 1)
    at = lambda h: start + dt.timedelta(hours=h)
    files = [[(1, at(3), 30.0), (1, at(0), 10.0), (2, at(0), 1.0)], [(1, at(2), 12.0), (1, at(5), None), (None, at(5), 1.0)], [(1, at(6), 31.0), (1, at(7), 99.0), (2, at(100), 90.0)], [(1, at(200), 0.0)], [(3, at(900), 0.0)]]
    schema = "station_id int, ts timestamp, temperature double"
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        out = run(spark, jobs.jumps_in_order(stream, "ts", "station_id", "temperature", 2.0, late="4 hours", keep="2 days"), "st4_order", tmp_path)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = {(r.station_id, round((r.ts - start).total_seconds() / 3600)): r.flag for r in out.collect()}
    assert got == {(1, 0): 0, (1, 2): 0, (1, 3): 16, (1, 5): 1, (1, 6): 0, (1, 7): 16, (1, 200): 0, (2, 0): 0, (2, 100): 0, (None, 5): 0}


def test_a_group_waits_with_one_timer():
    """Each row had a timer of its own, which is a call from Spark to Python for every hour of every station."""

    class State:
        rows, timers = None, []

        def exists(self):
            return self.rows is not None

        def get(self):
            return self.rows

        def clear(self):
            self.rows = None

        def put(self, rows):
            self.rows = rows

        update = put

        def appendList(self, rows):
            self.rows = (self.rows or []) + rows

        def getListState(self, *_):
            return State()

        getValueState = getListState

        def registerTimer(self, ms):
            self.timers.append(ms)

    class At:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentWatermarkInMs(self):
            return self.ms

    hour, handle = 3_600_000, State()
    p = jobs._InOrder(2.0, 60 * 24 * hour * 1000)
    p.init(handle)
    rows = pd.DataFrame({"at": [h * hour * 1000 for h in (5, *range(500, 5, -1))], "value": 1.0})
    assert [*p.handleInputRows((1,), iter([rows]), None)] == [] and handle.timers == [5 * hour]
    first = pd.concat(p.handleExpiredTimer((1,), At(100 * hour), None))
    assert len(first) == 96 and 101 * hour in handle.timers  # the first row that still waits
    assert len(pd.concat(p.handleExpiredTimer((1,), At(500 * hour), None))) == 400 and len(handle.timers) <= 4
