"""Quality flags, filters and reports. Nothing is ever filled in."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nivalis.operators.ranking import exact_quantiles

GOOD, MISSING, BELOW, ABOVE, OUTLIER, TEMPORAL = 0, 1, 2, 4, 8, 16
#: Physical limits by column name (none: no bound).
LIMITS = {
    "temperature": (-60.0, 50.0), "temp": (-60.0, 50.0), "air_temperature": (-60.0, 50.0), "t2m": (-60.0, 50.0),
    "precipitation": (0.0, None), "precip": (0.0, None), "prcp": (0.0, None), "tp": (0.0, None),
    "snow_depth": (0.0, None), "snwd": (0.0, None), "swe": (0.0, None),
    "wind_speed": (0.0, 100.0), "wind": (0.0, 100.0), "u10": (-100.0, 100.0), "v10": (-100.0, 100.0),
    "humidity": (0.0, 100.0), "relative_humidity": (0.0, 100.0), "rh": (0.0, 100.0),
    "pressure": (300.0, 1100.0), "msl": (300.0, 1100.0), "sp": (300.0, 1100.0), "elevation": (0.0, 5000.0), "altitude": (0.0, 5000.0),
    "latitude": (-90.0, 90.0), "lat": (-90.0, 90.0), "longitude": (-180.0, 180.0), "lon": (-180.0, 180.0),
}
#: Most that a value can change in an hour.
HOURLY_CHANGE = {"temperature": 15.0, "temp": 15.0, "air_temperature": 15.0, "t2m": 15.0, "snow_depth": 30.0, "snwd": 30.0, "swe": 10.0, "pressure": 10.0, "msl": 10.0}


def _numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float", "integer", "long") and not f.name.endswith("_flag")]


def physical(df: DataFrame, limits: dict | None = None) -> DataFrame:
    """`<column>_physical_flag` for every column with limits."""
    limits = LIMITS | (limits or {})
    out = []
    for c in df.columns:
        if c.lower() in limits:
            low, high = limits[c.lower()]
            flag = F.when(F.col(c).isNull(), MISSING)
            flag = flag if low is None else flag.when(F.col(c) < low, BELOW)
            flag = flag if high is None else flag.when(F.col(c) > high, ABOVE)
            out.append(flag.otherwise(GOOD).alias(f"{c}_physical_flag"))
    return df.select("*", *out)


def outliers(df: DataFrame, columns: list[str], method: str = "iqr", threshold: float | None = None, group: list[str] = (), exact: bool = True, few: int = 100_000) -> DataFrame:
    """`<column>_outlier_flag` (W8b), over all rows or by group: outside the quartiles by `threshold` times their distance, or
    `threshold` standard deviations from the mean. Fewer than 3 values or no spread: none. The statistics are one row a group.
    Null groups are a group. Exact quartiles of a group of more than `few` values are found by counting; `exact=False` takes approximate ones."""
    k, group = threshold if threshold is not None else 3.0, list(group)
    by = df.groupBy(*group)
    counted = method == "iqr" and exact and not by.count().filter(F.col("count") > few).isEmpty()
    stats = []
    for c in columns:
        x = F.col(c)
        if counted:
            low = high = F.lit(None).cast("double")
        elif method == "iqr":
            pct = F.percentile if exact else F.percentile_approx
            q1, q3 = pct(x, F.lit(0.25)), pct(x, F.lit(0.75))
            low, high = q1 - k * (q3 - q1), q3 + k * (q3 - q1)
        else:
            s = F.nullif(F.stddev_samp(x), F.lit(0.0))
            low, high = F.avg(x) - k * s, F.avg(x) + k * s
        enough = F.count(x) >= 3
        stats += [enough.alias(f"_{c}_enough"), F.when(enough, low).alias(f"_{c}_low"), F.when(enough, high).alias(f"_{c}_high")]
    keys = [F.col(g).alias(f"_g{i}") for i, g in enumerate(group)]
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)], F.lit(True))
    one = by.agg(*stats).select(*keys, *[f"_{c}_{x}" for c in columns for x in ("enough", "low", "high")])
    for c in columns if counted else ():
        q = exact_quantiles(df, c, [0.25, 0.75], group, few).select(*[F.col(g).alias(f"_h{i}") for i, g in enumerate(group)], F.col("quantiles")[0].alias("_q1"), F.col("quantiles")[1].alias("_q3"))
        match = reduce(lambda a, b: a & b, [F.col(f"_g{i}").eqNullSafe(F.col(f"_h{i}")) for i in range(len(group))], F.lit(True))
        far = k * (F.col("_q3") - F.col("_q1"))
        one = one.join(q, match).withColumns({f"_{c}_low": F.when(F.col(f"_{c}_enough"), F.col("_q1") - far), f"_{c}_high": F.when(F.col(f"_{c}_enough"), F.col("_q3") + far)}).drop("_q1", "_q3", *[f"_h{i}" for i in range(len(group))])
    joined = df.join(one, same) if group else df.crossJoin(F.broadcast(one))  # one row
    flags = [F.when(F.col(c).isNull(), MISSING).when((F.col(c) < F.col(f"_{c}_low")) | (F.col(c) > F.col(f"_{c}_high")), OUTLIER).otherwise(GOOD).alias(f"{c}_outlier_flag") for c in columns]
    return joined.select(*df.columns, *flags)


def temporal(df: DataFrame, ts: str, group: list[str] = (), changes: dict | None = None, ties: list[str] = ()) -> DataFrame:
    """`<column>_temporal_flag` (W8a): the change since the row before is more than the hours between allow. Rows of one time are in
    order of `ties`."""
    changes = HOURLY_CHANGE | (changes or {})
    w = W.partitionBy(*group).orderBy(ts, *ties)
    hours = F.timestamp_diff("SECOND", F.lag(ts).over(w), F.col(ts)) / 3600.0
    out = []
    for c in df.columns:
        if c.lower() in changes:
            jump = (hours > 0) & (F.abs(F.col(c) - F.lag(c).over(w)) > hours * changes[c.lower()])
            out.append(F.when(F.col(c).isNull(), MISSING).when(jump, TEMPORAL).otherwise(GOOD).alias(f"{c}_temporal_flag"))
    return df.select("*", *out)


def combined(df: DataFrame, combine: str = "or") -> DataFrame:
    """`quality_flag` of all `*_flag` columns: their bits together, or ("max") the largest (W8d)."""
    flags = [F.col(c) for c in df.columns if c.endswith("_flag") and c != "quality_flag"]
    if not flags:
        return df.withColumn("quality_flag", F.lit(GOOD))
    return df.withColumn("quality_flag", F.greatest(*flags, F.lit(GOOD)) if combine == "max" else reduce(lambda a, b: a.bitwiseOR(b), flags))


def flagged(df: DataFrame, ts: str, group: list[str] = (), columns: list[str] | None = None, combine: str = "or", ties: list[str] = (), **outlier_args) -> DataFrame:
    """All three checks on the data columns, and `quality_flag`."""
    columns = columns or [c for c in _numeric(df) if c.lower() in LIMITS]
    return combined(temporal(outliers(physical(df), columns, **outlier_args), ts, group, ties=ties), combine)


def valid_only(df: DataFrame, min_completeness: float = 0.8, exclude: int = MISSING | BELOW | ABOVE | OUTLIER | TEMPORAL) -> DataFrame:
    """Rows with enough values and none of the excluded flags; MISSING always counts."""
    columns = _numeric(df)
    have = reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in columns], F.lit(0))
    keep = have / F.lit(max(len(columns), 1)) >= min_completeness
    if "quality_flag" in df.columns:
        keep = keep & (F.col("quality_flag").bitwiseAND(F.lit(exclude | MISSING)) == 0)
    return df.filter(keep)


def report(df: DataFrame, columns: list[str], acceptable: float = 80.0) -> DataFrame:
    """One row: total, valid, missing share, violations summed over columns, issues (A12). `df` has the flags."""
    have = set(df.columns)
    count = lambda suffix, bits: reduce(lambda a, b: a + b, [F.count_if(F.col(f"{c}_{suffix}_flag").bitwiseAND(F.lit(bits)) > 0) for c in columns if f"{c}_{suffix}_flag" in have], F.lit(0))
    n = F.count("*")
    missing = reduce(lambda a, b: a + b, [F.count_if(F.col(c).isNull()) for c in columns])
    good = F.count_if(F.col("quality_flag") == 0)
    out = df.agg(n.alias("total"), good.alias("valid"), F.try_divide(missing * 100.0, n * len(columns)).alias("missing_pct"), count("outlier", OUTLIER).cast("long").alias("outliers"), count("physical", BELOW | ABOVE).cast("long").alias("physical_violations"), count("temporal", TEMPORAL).cast("long").alias("temporal_violations"))
    pct = F.try_divide(F.col("valid") * 100.0, F.col("total"))
    issues = F.filter(F.array(F.when(F.col("missing_pct") > 20, F.lit("many missing values")), F.when(F.col("outliers") > 0, F.lit("outliers")), F.when(F.col("physical_violations") > 0, F.lit("values out of physical limits")), F.when(F.col("temporal_violations") > 0, F.lit("jumps in time"))), lambda x: x.isNotNull())
    return out.select("*", pct.alias("valid_pct"), F.coalesce(pct >= acceptable, F.lit(False)).alias("acceptable"), issues.alias("issues"))


def column_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, missing, mean, std, min, max), one row a column, in one pass over the rows."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns]))
    return df.select(pairs.alias("p")).groupBy("p.column").agg(F.count("*").alias("n"), F.count_if(F.col("p.x").isNull()).alias("missing"), F.avg("p.x").alias("mean"), F.stddev_samp("p.x").alias("std"), F.min("p.x").alias("min"), F.max("p.x").alias("max"))
