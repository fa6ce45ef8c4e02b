"""Verification of predictions: metrics, breakdowns, residuals, comparisons, bootstrap."""

from __future__ import annotations

import functools
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nivalis.operators.ranking import exact_quantiles
from pyspark.sql import types as T

THRESHOLD = 2.5
TARGETS = {"rmse": 15.0, "f1": 0.85, "improvement": 0.20, "bias": 5.0}
ELEVATION_BANDS = [0, 2000, 2500, 3000, 3500, math.inf]
STORM_BINS = [0, 2.5, 10, 25, 50, 100, math.inf]


def metrics(y: str = "y_true", p: str = "y_pred", threshold: float = THRESHOLD) -> list[Column]:
    """rmse, mae, bias, f1, precision, recall, n_samples as aggregates of one pass (A13-A15). Pairs with a missing side don't
    count but in n_samples; what can't be said is NULL."""
    e = F.col(p) - F.col(y)
    both = e.isNotNull()
    actual, said = F.col(y) >= threshold, F.col(p) >= threshold
    tp, fp, fn = (F.count_if(both & c) for c in (actual & said, ~actual & said, actual & ~said))
    precision, recall = F.try_divide(tp, F.nullif(tp + fp, F.lit(0))), F.try_divide(tp, F.nullif(tp + fn, F.lit(0)))
    return [F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"), F.when(tp + fn > 0, F.try_divide(2 * tp, 2 * tp + fp + fn)).alias("f1"), precision.alias("precision"), recall.alias("recall"), F.count("*").alias("n_samples")]


def by_group(df: DataFrame, *groups: str, **args) -> DataFrame:
    """Metrics of all rows, or by group."""
    return df.groupBy(*groups).agg(*metrics(**args))


def prd(df: DataFrame, baseline: str = "y_base") -> DataFrame:
    """Metrics, improvement over a baseline, and whether targets are met."""
    e = F.col(baseline) - F.col("y_true")
    out = df.agg(*metrics(), F.sqrt(F.avg(e * e)).alias("baseline_rmse"))
    better = F.try_divide(F.col("baseline_rmse") - F.col("rmse"), F.nullif(F.col("baseline_rmse"), F.lit(0.0)))
    met = lambda c: F.coalesce(c, F.lit(False))
    out = out.withColumn("improvement", better)
    return out.select("*", met(F.col("rmse") < TARGETS["rmse"]).alias("rmse_met"), met(F.col("f1") > TARGETS["f1"]).alias("f1_met"), met(F.col("improvement") > TARGETS["improvement"]).alias("improvement_met"), met(F.abs("bias") < TARGETS["bias"]).alias("bias_met"))


def band(x: Column, edges: list) -> Column:
    """Left-closed band of x as text."""
    label = lambda a, b: f"{int(a)}-{'+' if math.isinf(b) else int(b)}"
    out = F.when(F.lit(False), None)
    for a, b in zip(edges, edges[1:], strict=False):
        out = out.when((x >= a) & (x < b), label(a, b))
    return out


def breakdowns(df: DataFrame, elevation_edges=ELEVATION_BANDS, storm_edges=STORM_BINS, by: list[str] = ()) -> DataFrame:
    """(breakdown, bucket, metrics) by month, station, elevation band and storm intensity (A18-A21) in one pass; months, bands
    and storms without rows are there with no samples. `by` names columns of few values, such as a model, that are kept apart."""
    by = list(by)
    d = df.select(*by, "y_true", "y_pred", F.month("date").cast("string").alias("month"), F.col("station_id").cast("string").alias("station"), band(F.col("elevation"), elevation_edges).alias("elevation_band"), band(F.col("y_true"), storm_edges).alias("storm"))
    kinds = ["month", "station", "elevation_band", "storm"]
    sets = d.groupingSets([[F.col(x) for x in (*by, k)] for k in kinds], *by, *kinds).agg(*metrics(), F.grouping_id().alias("_g"))
    bits = {k: 2 ** len(kinds) - 1 - 2 ** (len(kinds) - 1 - i) for i, k in enumerate(kinds)}
    which, bucket = F.when(F.lit(False), None), F.when(F.lit(False), None)
    for k, g in bits.items():
        which, bucket = which.when(F.col("_g") == g, k), bucket.when(F.col("_g") == g, F.col(k))
    out = sets.select(*by, which.alias("breakdown"), bucket.alias("bucket"), "rmse", "mae", "bias", "f1", "n_samples").filter("bucket is not null")
    names = lambda edges: [f"{int(a)}-{'+' if math.isinf(b) else int(b)}" for a, b in zip(edges, edges[1:], strict=False)]
    every = [("month", str(m)) for m in range(1, 13)] + [("elevation_band", x) for x in names(elevation_edges)] + [("storm", x) for x in names(storm_edges)]
    fixed = df.sparkSession.createDataFrame(every, "breakdown string, bucket string")
    if by:  # some buckets for each of few values
        fixed = df.select(*by).distinct().crossJoin(F.broadcast(fixed))
    out = fixed.join(out, [*by, "breakdown", "bucket"], "full_outer")
    return out.withColumn("n_samples", F.coalesce("n_samples", F.lit(0).cast("long")))


def residual_summary(df: DataFrame, exact: bool = True, few: int = 100_000) -> DataFrame:
    """One row of the residuals y_pred - y_true (A22): population spread, skewness, excess kurtosis. The exact median of more than
    `few` residuals is found by counting; `exact=False` takes an approximate one."""
    e = F.col("y_pred") - F.col("y_true")
    n, s = F.count(e), F.stddev_pop(e)
    counted = exact and df.count() > few
    middle = F.lit(None).cast("double") if counted else (F.percentile if exact else F.percentile_approx)(e, F.lit(0.5))
    out = df.agg(F.avg(e).alias("mean"), s.alias("std"), middle.alias("median"), F.min(e).alias("min"), F.max(e).alias("max"), F.when((n >= 3) & (s > 0), F.skewness(e)).alias("skewness"), F.when((n >= 4) & (s > 0), F.kurtosis(e)).alias("kurtosis"))
    if counted:
        found = exact_quantiles(df.select(e.alias("e")), "e", [0.5], few=few)
        out = out.crossJoin(F.broadcast(found)).withColumn("median", F.col("quantiles")[0]).drop("quantiles")  # one row each
    return out


def residuals_by(df: DataFrame, *keys) -> DataFrame:
    """Mean, sample spread, count and mean size of residuals by month, station or others."""
    e = F.col("y_pred") - F.col("y_true")
    return df.groupBy(*keys).agg(F.avg(e).alias("mean_bias"), F.stddev_samp(e).alias("std_bias"), F.count(e).alias("n"), F.avg(F.abs(e)).alias("mean_abs_error"))


def condition_correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(condition, correlation, n) of residuals with each column (A24); NULL for fewer than 3 pairs."""
    e = F.col("y_pred") - F.col("y_true")
    pairs = df.select(e.alias("e"), F.explode(F.array(*[F.struct(F.lit(c).alias("condition"), F.col(c).cast("double").alias("x")) for c in columns if c in df.columns])).alias("p")).filter("e is not null and p.x is not null")
    return pairs.groupBy("p.condition").agg(F.when(F.count("*") >= 3, F.corr("e", "p.x")).alias("correlation"), F.count("*").alias("n"))


def trend(df: DataFrame, date: str = "date") -> DataFrame:
    """Slope of |residual| over days since the first, intercept, change a year, whether it grows."""
    first = df.agg(F.min(date).alias("_first"))  # one row
    x = F.date_diff(date, "_first").cast("double")
    y = F.abs(F.col("y_pred") - F.col("y_true"))
    out = df.crossJoin(F.broadcast(first)).agg(F.coalesce(F.regr_slope(y, x), F.lit(0.0)).alias("slope"), F.coalesce(F.regr_intercept(y, x), F.avg(y)).alias("intercept"))
    return out.select("slope", "intercept", (F.col("slope") * 365).alias("per_year"), (F.col("slope") > 0.01).alias("degrading"))


def long_predictions(df: DataFrame, models: dict[str, str], keep: list[str] = ()) -> DataFrame:
    """(keep, y_true, model, y_pred) from a column for each model."""
    return df.select(*keep, "y_true", F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).cast("double").alias("y_pred")) for m, c in models.items()])).alias("m")).select(*keep, "y_true", "m.*")


def compare(df: DataFrame, models: dict[str, str], *groups: str) -> DataFrame:
    """Metrics by model, and by group."""
    return long_predictions(df, models, list(groups)).groupBy("model", *groups).agg(*metrics())


def ranked(table: DataFrame, metric: str) -> DataFrame:
    """Models with their rank: the smallest error first, else the largest score; NULL is left out (T3). The table has a row a model."""
    key = F.col(metric) if metric in ("rmse", "mae") else F.abs(metric) if metric == "bias" else -F.col(metric)
    return table.filter(F.col(metric).isNotNull()).select("model", metric, F.row_number().over(W.orderBy(key, "model")).cast("long").alias("rank"))


def _cells(*columns: str) -> list[Column]:
    """Numbers of three places, halves to even."""
    number = lambda c: F.lpad(F.when(F.col(c).isNull(), "N/A").otherwise(F.format_string("%.3f", F.bround(c, 3))), 10, " ")
    return [x for c in columns for x in (F.lit(" "), number(c))]


def _printed(c: str) -> Column:
    """A number of three places by its binary value, as C's printf has it: -0.3765 is a little more than a half."""

    @F.pandas_udf("string")
    def text(x: pd.Series) -> pd.Series:
        return x.map(lambda v: f"{v:.3f}")

    return F.lpad(F.when(F.col(c).isNull(), "N/A").otherwise(text(F.coalesce(c, F.lit(0.0)))), 10, " ")


def report_lines(table: DataFrame, best_by: tuple[str, ...] = ("rmse", "f1"), strata: DataFrame | None = None) -> DataFrame:
    """(section, place, line): a comparison as text (A39): a line a model, rankings, the best. `table` has a row a model.

    `strata` (model, breakdown, bucket, metrics; `breakdowns(by=["model"])`) adds a section for each model and breakdown, of a line
    a bucket in order of its name: as many as there are stations, each section numbered for itself."""
    whole = F.concat(F.rpad("model", 20, " "), *[x for c in ("rmse", "mae", "bias", "f1") for x in (F.lit(" "), _printed(c))])
    out = table.select(F.lit("overall").alias("section"), F.row_number().over(W.orderBy("model")).cast("long").alias("place"), whole.alias("line"))
    for m in best_by:
        r = ranked(table, m)
        out = out.unionByName(r.select(F.lit(f"by {m}").alias("section"), F.col("rank").alias("place"), F.format_string("%d. %s: %.4f", "rank", "model", m).alias("line")))
        out = out.unionByName(r.filter("rank = 1").select(F.lit("best").alias("section"), F.lit(best_by.index(m) + 1).cast("long").alias("place"), F.format_string(f"Best by {m}: %s (%.4f)", "model", m).alias("line")))
    if strata is not None:
        place = F.row_number().over(W.partitionBy("model", "breakdown").orderBy("bucket")).cast("long")
        line = F.concat(F.rpad("bucket", 20, " "), *_cells("rmse", "mae", "bias", "f1"), F.lit(" "), F.lpad(F.col("n_samples").cast("string"), 10, " "))
        out = out.unionByName(strata.select(F.concat("model", F.lit(" by "), "breakdown").alias("section"), place.alias("place"), line.alias("line")))
    return out


def best(table: DataFrame, metric: str) -> DataFrame:
    """The best model by a metric; bias: the nearest to 0 (T4)."""
    key = F.abs(metric) if metric == "bias" else F.col(metric) if metric in ("rmse", "mae") else -F.col(metric)
    return table.filter(F.col(metric).isNotNull()).agg(F.min_by("model", F.struct(key, "model")).alias("model"))


def _beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_tail(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or tiny)
    total = d
    for m in range(1, 500):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / ((1 + k * d) or tiny), (1 + k / c) or tiny
            total *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * total


@F.pandas_udf(T.DoubleType())
def t_test_p(t: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p value of Student's t with n - 1 degrees of freedom; for tables of a few rows."""
    return pd.Series([None if pd.isna(x) or m < 2 else _beta_tail((m - 1) / 2, 0.5, (m - 1) / (m - 1 + x * x)) for x, m in zip(t, n, strict=True)], dtype="float64")


def significance(df: DataFrame, a: str, b: str, alpha: float = 0.05) -> DataFrame:
    """Paired t-test of two models' squared errors (A29): t, n, p, significant, better (a or b; NULL if neither)."""
    d = F.pow(F.col(a) - F.col("y_true"), 2) - F.pow(F.col(b) - F.col("y_true"), 2)
    out = df.agg(F.avg(d).alias("mean_difference"), F.try_divide(F.avg(d), F.nullif(F.stddev_samp(d), F.lit(0.0)) / F.sqrt(F.count(d))).alias("t"), F.count(d).alias("n"))
    out = out.withColumn("p", t_test_p("t", "n"))
    sure = F.coalesce(F.col("p") < alpha, F.lit(False))
    return out.select("*", sure.alias("significant"), F.when(sure, F.when(F.col("mean_difference") < 0, a).otherwise(b)).alias("better"))


@functools.cache
def _poisson_table() -> tuple:
    """Of the first 16 bits of a uniform number the Poisson(1) draw, 255 where more bits decide; and the bounds, of 53 bits."""
    import numpy as np

    bounds, p = [], math.exp(-1)
    c = p
    for j in range(1, 12):
        bounds.append(math.floor(c * 2.0**53))  # exact: a number of 53 bits exceeds c if it exceeds this one
        p /= j
        c += p
    cut = np.array(bounds)
    first = np.arange(65536, dtype=np.int64) << 37
    low, high = np.searchsorted(cut, first), np.searchsorted(cut, first + (1 << 37) - 1)
    return np.where(low == high, low, 255).astype(np.uint8), cut


def poisson_draws(h):
    """Poisson(1) draws of 64-bit numbers, which are mixed first: how many cumulative probabilities the uniform number exceeds."""
    import numpy as np

    table, cut = _poisson_table()
    u = h * np.uint64(0xBF58476D1CE4E5B9)
    u ^= u >> np.uint64(31)
    u *= np.uint64(0x94D049BB133111EB)
    u ^= u >> np.uint64(29)
    w = table.take((u >> np.uint64(48)).view(np.int64))
    flat, at = w.reshape(-1), np.flatnonzero(w.reshape(-1) == 255)
    flat[at] = np.searchsorted(cut, (u.reshape(-1)[at] >> np.uint64(11)).view(np.int64))
    return w.astype(float)


def bootstrap(df: DataFrame, n: int = 1000, level: float = 0.95, seed: int = 42, row_id: list[str] | None = None) -> DataFrame:
    """(metric, estimate, lower, upper) of rmse, mae, bias and f1 (A17), by Poisson resampling.

    A resample weighs each row by a Poisson(1) draw from a hash of (row, resample); sums are made a partition at a time,
    so what is shuffled is `n` rows a partition. `row_id` names columns that tell rows apart; without it equal rows are
    numbered (one shuffle), so that each is drawn for itself. The estimate is of the rows as they are."""
    import numpy as np

    rows = df.filter("y_true is not null and y_pred is not null")
    if row_id is None:
        equal = F.xxhash64(*df.columns)
        rows = rows.withColumn("_h", equal).withColumn("_n", F.row_number().over(W.partitionBy("_h").orderBy("_h")))
        row_id = ["_h", "_n"]
    rows = rows.select(F.xxhash64(*row_id).alias("h"), F.col("y_true").cast("double"), F.col("y_pred").cast("double"))

    def sums(batches):
        total = np.zeros((n + 1, 7))
        seeds = (np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))[:, None]
        for pdf in batches:
            e = (pdf.y_pred - pdf.y_true).to_numpy()
            a, s = pdf.y_true.to_numpy() >= THRESHOLD, pdf.y_pred.to_numpy() >= THRESHOLD
            x = np.stack([np.ones(len(e)), e * e, np.abs(e), e, a & s, ~a & s, a & ~s], 1)
            h = pdf.h.to_numpy().view(np.uint64)
            for i in range(0, len(h), 1000):  # draws of 50 resamples and 1000 rows stay in a core's cache
                for k in range(0, n, 50):
                    total[k : min(k + 50, n)] += poisson_draws(h[None, i : i + 1000] ^ seeds[k : k + 50]) @ x[i : i + 1000]
            total[n] += x.sum(0)  # all rows once
        yield pd.DataFrame({"b": range(n + 1), **{f"s{i}": total[:, i] for i in range(7)}})

    drawn = rows.mapInPandas(sums, "b int, " + ", ".join(f"s{i} double" for i in range(7))).groupBy("b").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(7)])
    c = F.col
    per = drawn.select("b", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), v.alias("v")) for m, v in (("rmse", F.sqrt(F.try_divide(c("s1"), c("s0")))), ("mae", F.try_divide(c("s2"), c("s0"))), ("bias", F.try_divide(c("s3"), c("s0"))), ("f1", F.try_divide(2 * c("s4"), 2 * c("s4") + c("s5") + c("s6"))))])).alias("m"))
    tail = (1 - level) / 2
    value = F.when(F.col("b") < n, F.col("m.v"))
    return per.groupBy("m.metric").agg(F.max(F.when(F.col("b") == n, F.col("m.v"))).alias("estimate"), F.percentile(value, F.lit(tail)).alias("lower"), F.percentile(value, F.lit(1 - tail)).alias("upper"))


def fold_summary(folds: DataFrame) -> DataFrame:
    """(metric, mean, std, min, max) over folds, population spread (A30). folds: fold, metric, value."""
    return folds.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))


def ensemble_importance(table: DataFrame) -> DataFrame:
    """(feature, importance) of weighted models, normalised to 1 (A36). table: feature, weight, importance."""
    s = table.groupBy("feature").agg(F.sum(F.col("weight") * F.col("importance")).alias("s"))
    total = s.agg(F.sum("s").alias("_t"))  # one row
    return s.crossJoin(F.broadcast(total)).select("feature", F.try_divide("s", "_t").alias("importance"))


def evaluate_holdout(df: DataFrame, conditions: list[str] = ()) -> dict[str, DataFrame]:
    """All of the above on one test set."""
    return {"metrics": prd(df) if "y_base" in df.columns else by_group(df), "breakdowns": breakdowns(df), "residuals": residual_summary(df), "by_month": residuals_by(df, F.month("date").alias("month")), "by_station": residuals_by(df, "station_id"), "conditions": condition_correlations(df, list(conditions)), "trend": trend(df)}
