"""Lagged, rolling and cumulative features: one window partition, one sort. Frames count rows, as the values come, or calendar days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LAGS, WINDOWS = (1, 2, 3, 7), (3, 7, 14)


def _order(df: DataFrame, order: str | None) -> str:
    if order:
        return order
    for c in ("date", "datetime", "timestamp", "time"):
        if c in df.columns:
            return c
    raise ValueError("an order column is needed: date, datetime, timestamp or time")


def features(df: DataFrame, variables: list[str], group: str | None, order: str | None = None, lags=LAGS, windows=WINDOWS, kinds=("lag", "mean", "std", "min_max", "trend", "sum"), frame: str = "rows") -> DataFrame:
    """W1-W6 in one select; `kinds` chooses. A missing variable is an error; groups don't see each other's rows. Without a group, all rows are one
    task's: only for a single short series.

    frame="rows": a window of n is the last n rows, a lag of n the row n before. frame="days": it is all rows of the last n
    calendar days, and a lag the mean of the values of the day n days before; so a day that is missing is a gap, rows of one day
    have the same frame, and rows without a date have NULL."""
    if missing := [v for v in variables if v not in df.columns]:
        raise ValueError(f"no such columns: {missing}")
    if frame not in ("rows", "days"):
        raise ValueError(f"no such frame: {frame}")
    by = W.partitionBy(*([group] if group else []))
    day = F.unix_date(F.col(_order(df, order)).cast("date")) if frame == "days" else None
    w = by.orderBy(_order(df, order) if day is None else day)
    last = lambda n: w.rowsBetween(-(n - 1), 0) if day is None else w.rangeBetween(-(n - 1), 0)
    before = lambda x, n: F.lag(x, n).over(w) if day is None else F.avg(x).over(w.rangeBetween(-n, -n))
    dated = lambda c: c if day is None else F.when(day.isNotNull(), c)
    out: dict[str, Column] = {}
    for v in variables:
        x = F.col(v)
        if "lag" in kinds:
            out |= {f"{v}_lag_{n}d": before(x, n) for n in lags}
        for n in windows:
            if "mean" in kinds:
                out[f"{v}_roll_mean_{n}d"] = F.avg(x).over(last(n))
            if "std" in kinds:
                out[f"{v}_roll_std_{n}d"] = F.stddev_samp(x).over(last(n))
            if "min_max" in kinds:
                out |= {f"{v}_roll_min_{n}d": F.min(x).over(last(n)), f"{v}_roll_max_{n}d": F.max(x).over(last(n))}
            if "trend" in kinds:
                past = before(x, n)
                out |= {f"{v}_change_{n}d": x - past, f"{v}_pct_change_{n}d": F.try_divide((x - past) * 100.0, F.nullif(past.cast("double"), F.lit(0.0)))}
            if "sum" in kinds:
                out[f"{v}_cumsum_{n}d"] = F.sum(x).over(last(n))
    return df.select("*", *[dated(c).alias(n) for n, c in out.items()])


def feature_names(variables: list[str], lags=LAGS, windows=WINDOWS) -> list[str]:
    """Names that `features` makes."""
    per = ("roll_mean", "roll_std", "roll_min", "roll_max", "change", "pct_change", "cumsum")
    return [f"{v}_lag_{n}d" for v in variables for n in lags] + [f"{v}_{k}_{n}d" for v in variables for n in windows for k in per]


def difference(df: DataFrame, value: str, rows: int, group: str | None, order: str, name: str) -> DataFrame:
    """Change over a number of rows, such as the 24-hour pressure tendency (W9). Without a group, all rows are one task's: only for
    a single short series."""
    w = W.partitionBy(*([group] if group else [])).orderBy(order)
    return df.withColumn(name, F.col(value) - F.lag(value, rows).over(w))


def standardised(df: DataFrame, values: list[str]) -> DataFrame:
    """`values` less their mean, over their population spread; 0 where there is none."""
    one = df.agg(*[x for i, c in enumerate(values) for x in (F.avg(c).alias(f"_m{i}"), F.nullif(F.stddev_pop(c), F.lit(0.0)).alias(f"_s{i}"))])  # one row
    z = {c: F.when(F.col(c).isNotNull(), F.coalesce((F.col(c) - F.col(f"_m{i}")) / F.col(f"_s{i}"), F.lit(0.0))).alias(c) for i, c in enumerate(values)}
    return df.crossJoin(F.broadcast(one)).select(*[z.get(c, F.col(c)) for c in df.columns])


def sequences(df: DataFrame, values: list[str], length: int, group: str, order: str, target: str, z_score: bool = False) -> DataFrame:
    """Each row with the last `length` rows of its group as an array, where there are as many (W12); `target` is the row's.
    `z_score` standardises the values (not the target) over all rows."""
    if z_score:
        df = standardised(df.withColumn("_target", F.col(target)), values)
        target = "_target"
    w = W.partitionBy(group).orderBy(order).rowsBetween(-(length - 1), 0)
    out = df.select(group, order, F.col(target).alias("target"), F.collect_list(F.struct(*values)).over(w).alias("sequence"))
    return out.filter(F.size("sequence") == length)


def largest_gap_hours(df: DataFrame, ts: str, group: list[str]) -> DataFrame:
    """(group, hours): the longest time between rows that follow each other."""
    w = W.partitionBy(*group).orderBy(ts)
    step = df.withColumn("_s", F.timestamp_diff("SECOND", F.lag(ts).over(w), F.col(ts)))
    return step.groupBy(*group).agg((F.max("_s") / 3600.0).alias("hours"))
