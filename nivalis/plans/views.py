"""The given tables as the frames that the operators work on; the same as SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        if spark.conf.get("spark.sql.session.timeZone") not in ("UTC", "Etc/UTC", "Z"):
            spark = spark.newSession()  # all times are UTC; the caller's session stays as it is
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def obs(self) -> DataFrame:
        return self.table("events").select(F.col("user_id").alias("station_id"), F.col("ts").alias("datetime"), F.col("event_type").alias("element"), "value", F.get_json_object("props", "$.k").cast("long").alias("k"), "event_id")

    @property
    def daily(self) -> DataFrame:
        return self.obs.groupBy("station_id", F.col("datetime").cast("date").alias("date")).agg(F.avg("value").alias("value"), F.sum("k").cast("double").alias("k"))

    def _places(self, table: str, key: str, nation: str) -> DataFrame:
        k = F.col(key)
        out = self.table(table).join(self.table("nation"), F.col(nation) == F.col("n_nationkey"))
        return out.select(k.alias("id"), (31 + (k * 7919 % 18000) / 1000.0).alias("lat"), (-125 + (k * 104729 % 23000) / 1000.0).alias("lon"), (k * 313 % 4000).cast("double").alias("elevation"), F.col("n_name").alias("state"))

    @property
    def stations(self) -> DataFrame:
        return self._places("supplier", "s_suppkey", "s_nationkey")

    @property
    def resorts(self) -> DataFrame:
        return self._places("customer", "c_custkey", "c_nationkey")

    @property
    def grid(self) -> DataFrame:
        """Yearly fields of a 20 by 20 grid."""
        return self.table("lineitem").groupBy(F.make_date(F.year("l_shipdate"), F.lit(1), F.lit(1)).alias("time"), (38 + (F.col("l_suppkey") % 20) * 0.5).alias("lat"), (-110 + (F.col("l_partkey") % 20) * 0.5).alias("lon")).agg(F.sum("l_quantity").alias("v"))

    @property
    def field(self) -> DataFrame:
        return self.grid.groupBy("lat", "lon").agg(F.sum("v").alias("v"))

    @property
    def dem(self) -> DataFrame:
        """Rasters of 32 by 32 cells."""
        k = F.col("o_orderkey")
        return self.table("orders").select(F.floor(k / 1024).alias("tile"), F.floor(k % 1024 / 32).alias("row"), (k % 32).alias("col"), (1500 + F.floor(F.col("o_totalprice") / 1000)).cast("double").alias("z"))

    @property
    def forecasts(self) -> DataFrame:
        k = F.col("o_orderkey")
        hour = (k % 49).cast("int")
        return self.table("orders").select(F.col("o_orderdate").alias("run_time"), (k % 49).alias("forecast_hour"), F.col("o_custkey").alias("location_id"), (F.col("o_orderdate") + F.make_dt_interval(hours=hour)).alias("valid_time"), (253 + k % 40).cast("double").alias("temp_k"), (k % 200 / 10.0).alias("precip_mm"), (k % 300 / 100.0).alias("snow_depth_m"), (k % 3 == 0).cast("double").alias("categorical_snow"), k.alias("fetch_id"))

    @property
    def terrain(self) -> DataFrame:
        k = F.col("c_custkey")
        return self.table("customer").select(k.alias("location_id"), (k * 313 % 4000).cast("double").alias("elevation"), (k * 7 % 50).cast("double").alias("slope"), (k * 37 % 360).cast("double").alias("aspect"), (k * 11 % 100).cast("double").alias("roughness"), (k * 13 % 121 - 60).cast("double").alias("tpi"))

    @property
    def surveyed(self) -> DataFrame:
        """Terrain of some places, for lookups that must do without."""
        some = self.table("customer").filter("c_acctbal > 2000").select(F.col("c_custkey").alias("location_id"))
        return self.terrain.join(some, "location_id", "left_semi")

    @property
    def preds(self) -> DataFrame:
        c = F.col
        return self.table("lineitem").select(c("l_quantity").alias("y_true"), (c("l_quantity") + c("l_partkey") % 21 - 10).alias("y_pred"), (c("l_quantity") + c("l_suppkey") % 31 - 15).alias("y_base"), c("l_shipdate").cast("date").alias("date"), c("l_suppkey").alias("station_id"), (c("l_suppkey") * 313 % 4000).alias("elevation"), (c("l_discount") * 100).alias("humidity"), (c("l_tax") * 100).alias("wind"))

    @property
    def weekly(self) -> DataFrame:
        """New snow and depth by place and day of a week."""
        k = F.col("o_orderkey")
        day = F.date_add(F.lit("2024-01-01").cast("date"), (k % 7).cast("int"))
        return self.table("orders").groupBy(F.col("o_custkey").alias("location_id"), day.alias("date"), (k % 7).alias("day")).agg(F.max(k % 31).cast("double").alias("new_snow_cm"), F.max(k % 173).cast("double").alias("snow_depth_cm"))

    @property
    def weather(self) -> DataFrame:
        """Atmosphere by event, from its value and key."""
        v, k = F.col("value"), F.col("k")
        return self.obs.select("event_id", "station_id", "datetime", (250 + k * 0.5).alias("t2m"), (245 + k * 0.5).alias("d2m"), (v / 10 - 3).alias("u10"), (k / 10.0 - 5).alias("v10"), (80000 + k * 200.0).alias("sp"), (v / 1000).alias("tp"), (v * (k % 3) / 3000).alias("sf"), (k / 50.0).alias("sd"))

    @property
    def raw_quality(self) -> DataFrame:
        """Measurements with impossible, missing and jumping values."""
        v, k = F.col("value"), F.col("k")
        return self.obs.select("event_id", "station_id", "datetime", F.when(k % 17 != 0, k - 40.0).alias("temperature"), F.when(k % 13 != 0, v * 2 - 20).alias("snow_depth"), (k * 1.3).alias("humidity"))


SQL = """
obs AS (SELECT user_id AS station_id, ts AS datetime, event_type AS element, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_id FROM events),
daily AS (SELECT station_id, CAST(datetime AS DATE) AS date, avg(value) AS value, CAST(sum(k) AS DOUBLE) AS k FROM obs GROUP BY ALL),
stations AS (SELECT s_suppkey AS id, 31 + (s_suppkey * 7919 % 18000) / 1000 AS lat, -125 + (s_suppkey * 104729 % 23000) / 1000 AS lon, CAST(s_suppkey * 313 % 4000 AS DOUBLE) AS elevation, n_name AS state FROM supplier JOIN nation ON s_nationkey = n_nationkey),
resorts AS (SELECT c_custkey AS id, 31 + (c_custkey * 7919 % 18000) / 1000 AS lat, -125 + (c_custkey * 104729 % 23000) / 1000 AS lon, CAST(c_custkey * 313 % 4000 AS DOUBLE) AS elevation, n_name AS state FROM customer JOIN nation ON c_nationkey = n_nationkey),
grid AS (SELECT make_date(year(l_shipdate), 1, 1) AS time, 38 + (l_suppkey % 20) / 2 AS lat, -110 + (l_partkey % 20) / 2 AS lon, sum(l_quantity) AS v FROM lineitem GROUP BY ALL),
field AS (SELECT lat, lon, sum(v) AS v FROM grid GROUP BY ALL),
dem AS (SELECT o_orderkey // 1024 AS tile, (o_orderkey % 1024) // 32 AS row, o_orderkey % 32 AS col, CAST(1500 + floor(o_totalprice / 1000) AS DOUBLE) AS z FROM orders),
forecasts AS (SELECT o_orderdate AS run_time, o_orderkey % 49 AS forecast_hour, o_custkey AS location_id, o_orderdate + to_hours(o_orderkey % 49) AS valid_time, CAST(253 + o_orderkey % 40 AS DOUBLE) AS temp_k, (o_orderkey % 200) / 10 AS precip_mm, (o_orderkey % 300) / 100 AS snow_depth_m, CAST(o_orderkey % 3 = 0 AS DOUBLE) AS categorical_snow, o_orderkey AS fetch_id FROM orders),
terrain AS (SELECT c_custkey AS location_id, CAST(c_custkey * 313 % 4000 AS DOUBLE) AS elevation, CAST(c_custkey * 7 % 50 AS DOUBLE) AS slope, CAST(c_custkey * 37 % 360 AS DOUBLE) AS aspect, CAST(c_custkey * 11 % 100 AS DOUBLE) AS roughness, CAST(c_custkey * 13 % 121 - 60 AS DOUBLE) AS tpi FROM customer),
surveyed AS (SELECT * FROM terrain WHERE location_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 2000)),
preds AS (SELECT l_quantity AS y_true, l_quantity + l_partkey % 21 - 10 AS y_pred, l_quantity + l_suppkey % 31 - 15 AS y_base, CAST(l_shipdate AS DATE) AS date, l_suppkey AS station_id, l_suppkey * 313 % 4000 AS elevation, l_discount * 100 AS humidity, l_tax * 100 AS wind FROM lineitem),
weekly AS (SELECT o_custkey AS location_id, DATE '2024-01-01' + CAST(o_orderkey % 7 AS INTEGER) AS date, o_orderkey % 7 AS day, CAST(max(o_orderkey % 31) AS DOUBLE) AS new_snow_cm, CAST(max(o_orderkey % 173) AS DOUBLE) AS snow_depth_cm FROM orders GROUP BY ALL),
weather AS (SELECT event_id, station_id, datetime, 250 + k * 0.5::DOUBLE AS t2m, 245 + k * 0.5::DOUBLE AS d2m, value / 10 - 3 AS u10, k / 10 - 5 AS v10, 80000 + k * 200.0::DOUBLE AS sp, value / 1000 AS tp, value * (k % 3) / 3000 AS sf, k / 50 AS sd FROM obs),
raw_quality AS (SELECT event_id, station_id, datetime, CASE WHEN k % 17 <> 0 THEN k - 40.0::DOUBLE END AS temperature, CASE WHEN k % 13 <> 0 THEN value * 2 - 20 END AS snow_depth, k * 1.3::DOUBLE AS humidity FROM obs)
"""
_NAMES = [line.split(" AS ")[0] for line in SQL.strip().splitlines()]


def sql(body: str) -> str:
    """`body` with the views it uses. r6(x) is x rounded to 6 places, without a negative zero."""
    import re

    used, todo = [], [body]
    lines = dict(zip(_NAMES, [line.rstrip(",") for line in SQL.strip().splitlines()], strict=True))
    while todo:
        text = todo.pop()
        for n in _NAMES:
            if re.search(rf"\b{n}\b", text.split(" AS ", 1)[-1] if text is not body else text) and n not in used and lines[n] != text:
                used.append(n)
                todo.append(lines[n])
    views = ",\n".join(lines[n] for n in _NAMES if n in used)
    while (i := body.find("r6(")) >= 0:
        depth, j = 1, i + 3
        while depth:
            depth += {"(": 1, ")": -1}.get(body[j], 0)
            j += 1
        body = f"{body[:i]}(round(CAST({body[i + 3 : j - 1]} AS DOUBLE), 6) + 0.0){body[j:]}"
    head = f"WITH {views}" if views else ""
    if body.lstrip().upper().startswith("WITH "):
        return f"{head},\n{body.lstrip()[5:]}" if head else body
    return f"{head}\n{body}"


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + 0.0


def rounded(df: DataFrame) -> DataFrame:
    """All doubles to 6 places, all whole numbers as bigint."""
    kind = {f.name: f.dataType.typeName() for f in df.schema.fields}
    one = lambda n: r6(n).alias(n) if kind[n] in ("double", "float") else F.col(n).cast("long").alias(n) if kind[n] in ("integer", "byte", "short") else F.col(n)
    return df.select(*map(one, df.columns))
