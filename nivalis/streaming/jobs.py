"""Streaming forms of the hourly jobs. Each gives what its batch operator gives, once the watermark has passed."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from nivalis.operators.quality import HOURLY_CHANGE, MISSING, TEMPORAL


def daily(stream: DataFrame, ts: str, group: list[str], aggs: list[Column], late: str = "1 hour") -> DataFrame:
    """Hourly to daily (ST1)."""
    out = stream.withWatermark(ts, late).groupBy(*group, F.window(ts, "1 day").alias("w")).agg(*aggs)
    return out.select(*group, F.col("w.start").cast("date").alias("date"), *[c for c in out.columns if c not in (*group, "w")])


def rolling(stream: DataFrame, ts: str, group: list[str], aggs: list[Column], days: int = 7, late: str = "1 hour") -> DataFrame:
    """Totals of the last `days` days, for every day (ST2)."""
    out = stream.withWatermark(ts, late).groupBy(*group, F.window(ts, f"{days} days", "1 day").alias("w")).agg(*aggs)
    return out.select(*group, F.date_sub(F.col("w.end").cast("date"), 1).alias("date"), *[c for c in out.columns if c not in (*group, "w")])


def events(stream: DataFrame, ts: str, group: list[str], value: str, least: float, gap: str = "1 day 1 hour", late: str = "1 hour") -> DataFrame:
    """Snow events as sessions of rows above a threshold (ST3)."""
    out = stream.withWatermark(ts, late).filter(F.col(value) >= least).groupBy(*group, F.session_window(ts, gap).alias("w"))
    out = out.agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.sum(value).alias("total"), F.max(value).alias("largest"), F.count("*").alias("n"))
    return out.drop("w")


class _Jumps(StatefulProcessor):
    """Last time and value of each group."""

    def __init__(self, ts: str, value: str, limit: float):
        self.ts, self.value, self.limit = ts, value, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "ts timestamp, value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            pdf = pdf.sort_values(self.ts)
            flags = []
            for t, v in zip(pdf[self.ts], pdf[self.value], strict=True):
                past = self.last.get() if self.last.exists() else None
                flag = 0
                if pd.isna(v):
                    flag = MISSING
                elif past is not None and past[1] is not None:
                    hours = (t - past[0]).total_seconds() / 3600
                    flag = TEMPORAL if hours > 0 and abs(v - past[1]) > hours * self.limit else 0
                self.last.update((t.to_pydatetime(), None if pd.isna(v) else float(v)))
                flags.append(flag)
            yield pdf.assign(flag=flags)

    def close(self) -> None:
        pass


def jumps(stream: DataFrame, ts: str, group: str, value: str, limit: float | None = None) -> DataFrame:
    """Temporal consistency, row by row against the one before (ST4). Needs the RocksDB state store. Columns: group, ts, value."""
    limit = limit if limit is not None else HOURLY_CHANGE[value.lower()]
    kind = dict(stream.dtypes)[group]
    return stream.select(group, ts, value).groupBy(group).transformWithStateInPandas(_Jumps(ts, value, limit), f"{group} {kind}, {ts} timestamp, {value} double, flag int", "Append", "None")


class _InOrder(StatefulProcessor):
    """Rows wait until the watermark has passed them; then they are compared in order of time. Times are microseconds."""

    def __init__(self, limit: float, keep_us: int):
        self.limit, self.keep_us = limit, keep_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, value double")
        self.last = handle.getValueState("last", "at long, value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            new = [(int(a), None if pd.isna(v) else float(v)) for a, v in zip(pdf["at"], pdf["value"], strict=True)]
            if new:
                self.waiting.appendList(new)
                self._wake(new)
        return iter(())

    def _wake(self, rows: list[tuple]) -> None:
        """One timer, for the first of the rows that wait: what it finds due is done at once, and what it leaves gets the next."""
        self.handle.registerTimer(-(-min(r[0] for r in rows) // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(self.waiting.get(), key=lambda r: (r[0], r[1] is not None, r[1] or 0.0)) if self.waiting.exists() else []
        due = [r for r in rows if r[0] <= passed]
        last, flags = (self.last.get() if self.last.exists() else None), []
        for at, value in due:
            hours = (at - last[0]) / 3.6e9 if last else 0.0
            known = last is not None and last[1] is not None and value is not None and at - last[0] <= self.keep_us
            flags.append(MISSING if value is None else TEMPORAL if known and hours > 0 and abs(value - last[1]) > hours * self.limit else 0)
            last = (at, value)
        if due:
            left = [tuple(r) for r in rows if r[0] > passed]
            if left:
                self.waiting.put(left)
                self._wake(left)
            else:
                self.waiting.clear()
        if last and last[0] + self.keep_us <= passed:
            self.last.clear()  # nothing is kept of a group that has been silent so long
        elif due:
            self.last.update(last)
            self.handle.registerTimer(-(-(last[0] + self.keep_us) // 1000))
        yield pd.DataFrame({"key": [key[0]] * len(due), "at": [r[0] for r in due], "value": [r[1] for r in due], "flag": flags})

    def close(self) -> None:
        pass


def jumps_in_order(stream: DataFrame, ts: str, group: str, value: str, limit: float | None = None, late: str = "1 hour", keep: str = "30 days") -> DataFrame:
    """(group, ts, value, flag): temporal consistency against the value before in time (ST4), as `quality.temporal` has it, once the watermark
    has passed a row. Needs the RocksDB state store.

    Rows up to `late` behind the latest are put in order, later ones are left out. The state of a group expires when it has been silent
    for `keep`, and a value after so long a gap is compared with none. Null groups are a group; rows without a time are left out."""
    limit = limit if limit is not None else HOURLY_CHANGE[value.lower()]
    kind, interval = dict(stream.dtypes)[group], pd.Timedelta(keep)
    rows = stream.filter(F.col(ts).isNotNull()).withWatermark(ts, late).select(F.col(group).alias("key"), F.col(ts).alias("time"), F.unix_micros(ts).alias("at"), F.col(value).cast("double").alias("value"))
    out = rows.groupBy("key").transformWithStateInPandas(_InOrder(limit, int(interval.total_seconds() * 1e6)), f"key {kind}, at long, value double, flag int", "Append", "EventTime")
    return out.select(F.col("key").alias(group), F.timestamp_micros("at").alias(ts), F.col("value").alias(value), "flag")


def each_batch(stream: DataFrame, write: Callable[[DataFrame], None] | Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    """Upserts (ST5) or monitors (ST6) a stream batch by batch. A batch may come again with the same number, after a failure:
    `write(df)` must give the same then, or `write(df, batch)` may go by the number, as `in_folders` does."""
    numbered = len(inspect.signature(write).parameters) > 1
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, batch: write(df, batch) if numbered else write(df))


def in_folders(path: str, make: Callable[[DataFrame], DataFrame] = lambda df: df) -> Callable[[DataFrame, int], None]:
    """A writer that puts `make` of each batch into a folder of its own, `batch=<number>`; one that comes again replaces it."""
    return lambda df, batch: make(df).write.mode("overwrite").parquet(f"{path}/batch={batch}")


def freshness(df: DataFrame, group: list[str]) -> DataFrame:
    """A batch's last run by group (ST6)."""
    return df.groupBy(*group).agg(F.max("run_time").alias("last_run"), F.count("*").alias("n"))


def matched(forecasts: DataFrame, observations: DataFrame, hours: int = 6, late: str = "12 hours") -> DataFrame:
    """Pairs of forecast (location_id, valid_time, ...) and observation (location_id, datetime, ...) within `hours` (ST7)."""
    f = forecasts.withWatermark("valid_time", late)
    o = observations.withColumnRenamed("location_id", "o_location").withWatermark("datetime", late)
    near = F.col("datetime").between(F.col("valid_time") - F.expr(f"interval {hours} hours"), F.col("valid_time") + F.expr(f"interval {hours} hours"))
    return f.join(o, (F.col("location_id") == F.col("o_location")) & near).drop("o_location")
