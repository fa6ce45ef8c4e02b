"""Models on tables, with Spark ML."""

from __future__ import annotations

import json
import math
import random
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import Evaluator, RegressionEvaluator
from pyspark.ml.feature import SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder, TrainValidationSplit
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nivalis.session import written

#: Names of columns that say that a feature is missing.
LACKS = "__lacks_"
#: How many equal rows a row of `counted` stands for.
ROWS = "__rows"


def counted(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct rows of the columns and, as ROWS, how many there are of each, written to the shared folder: training makes many passes,
    and measured values have few combinations, however many rows. Where all rows differ it is as long as `df`."""
    n = F.sum(ROWS) if ROWS in df.columns else F.count("*")
    return written(df.groupBy(*[F.col(f"`{c}`") for c in dict.fromkeys(columns)]).agg(n.cast("double").alias(ROWS)))


def temporal_holdout(df: DataFrame, ts: str, test_years: int = 2, cutoff: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Train strictly before the cutoff, test from it on; the cutoff is `test_years` before the last time (M6)."""
    if cutoff is None:
        cutoff = df.agg((F.max(ts) - F.make_interval(F.lit(test_years))).cast("timestamp")).first()[0]
    return df.filter(F.col(ts) < F.lit(cutoff)), df.filter(F.col(ts) >= F.lit(cutoff))


def station_folds(df: DataFrame, station: str, k: int, seed: int = 42) -> DataFrame:
    """`df` with `fold` 0..k-1: whole stations, sizes that differ by one at most (M7)."""
    ids = df.select(station).distinct()
    if (n := ids.count()) < k:
        raise ValueError(f"{n} stations are fewer than {k} folds")
    folds = ids.select(station, (F.ntile(k).over(W.orderBy(F.xxhash64(station, F.lit(seed)), station)) - 1).alias("fold"))  # a row a station
    return df.join(folds, station)


def ridge(train: DataFrame, features: list[str], target: str, alpha: float = 1.0) -> PipelineModel:
    """Ridge on standardised features (M1). Rows with NULLs must be dropped before: nothing is imputed. Rows of `counted` weigh as
    many as they stand for."""
    if ROWS in train.columns:
        n, mean = train.agg(F.sum(ROWS), F.sum(F.col(target) * F.col(ROWS)) / F.sum(ROWS)).first()
        s = train.agg(F.sqrt(F.sum((F.col(target) - F.lit(mean)) ** 2 * F.col(ROWS)) / F.lit(n)), F.lit(n)).first()
    else:
        s = train.agg(F.stddev_pop(target), F.count("*")).first()
    model = LinearRegression(featuresCol="features", labelCol=target, solver="normal", elasticNetParam=0.0, standardization=True, regParam=alpha * (s[0] or 0.0) / max(s[1] or 0, 1))
    if ROWS in train.columns:
        model = model.setWeightCol(ROWS)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="error"), model]).fit(train)


def boosted(train: DataFrame, features: list[str], target: str, categorical: list[str] = (), validation: str | None = None, rows: float = 1.0, columns: str = "all", **args) -> PipelineModel:
    """Gradient-boosted trees (M2); `validation` names a boolean column of the rows that stop training early. `rows`: share of
    rows that a tree sees; `columns`: how many features a split sees ("all", "sqrt", "onethird", or a share such as "0.8").

    Every row has a prediction: a missing feature (NULL or NaN) is 0 and has an indicator beside it, both made in the pipeline; an
    unknown category is a category. Rows without a target don't train.

    Equal rows train as one that weighs as many, which gives the same sums in every node; not so where `rows` draws among them or
    `args` have rules for single rows."""
    pipe = boosted_pipeline(features, target, categorical, validation, **({"subsamplingRate": rows, "featureSubsetStrategy": columns} | args))
    train = train.filter(F.col(target).isNotNull())
    if rows < 1 or {"minInstancesPerNode", "weightCol", "subsamplingRate"} & set(args):
        if ROWS in train.columns:
            raise ValueError("these arguments want single rows, not those of `counted`")
        return pipe.fit(train)
    *before, gbt = pipe.getStages()
    index = Pipeline(stages=before[: len(categorical)]).fit(train)  # categories are in order of their rows
    rest = Pipeline(stages=[*before[len(categorical) :], gbt.setWeightCol(ROWS)])
    known = [x.getOutputCol() for x in index.stages]
    return PipelineModel([*index.stages, *rest.fit(counted(index.transform(train), [*features, *known, target, *([validation] if validation else [])])).stages])


def boosted_pipeline(features: list[str], target: str, categorical: list[str] = (), validation: str | None = None, **args) -> Pipeline:
    """What `boosted` fits."""
    index = [StringIndexer(inputCol=c, outputCol=f"{c}_index", handleInvalid="keep") for c in categorical]
    known = [f"__known_{i}" for i in range(len(features))]
    lacks = [f"{LACKS}{i}" for i in range(len(features))]
    real = [f"nanvl(CAST(`{c}` AS DOUBLE), NULL)" for c in features]
    made = [f"coalesce({x}, 0D) AS {k}, CAST({x} IS NULL AS DOUBLE) AS {i}" for x, k, i in zip(real, known, lacks, strict=True)]
    fill = SQLTransformer(statement=f"SELECT *, {', '.join(made)} FROM __THIS__")
    join = VectorAssembler(inputCols=[*known, *(f"{c}_index" for c in categorical), *lacks], outputCol="features", handleInvalid="error")
    drop = SQLTransformer(statement=f"SELECT * EXCEPT ({', '.join([*known, *lacks])}) FROM __THIS__")
    gbt = GBTRegressor(featuresCol="features", labelCol=target, **({"maxIter": 20, "maxDepth": 4, "seed": 1} | args))
    if validation:
        gbt = gbt.setValidationIndicatorCol(validation)
    return Pipeline(stages=[*index, fill, join, drop, gbt])


def importance(model: PipelineModel, features: list[str]) -> dict[str, float]:
    """Feature: importance, that of its being missing included; of a linear model the size of its coefficients. `features`: numeric
    ones, then categorical ones."""
    last = model.stages[-1]
    values = list(map(float, last.featureImportances.toArray() if hasattr(last, "featureImportances") else abs(last.coefficients.toArray())))
    out = dict(zip(features, values, strict=False))
    columns = next((x.getInputCols() for x in model.stages if isinstance(x, VectorAssembler)), [])
    for c, more in zip(columns, values, strict=False):
        if c.startswith(LACKS):
            out[features[int(c.removeprefix(LACKS))]] += more
    return out


def importance_table(spark: SparkSession, model: PipelineModel, features: list[str]) -> DataFrame:
    """(feature, importance), the largest first."""
    return spark.createDataFrame(list(importance(model, features).items()), "feature string, importance double").orderBy(F.desc("importance"), "feature")


def ensemble(df: DataFrame, weights: dict[str, float], how: str = "mean", name: str = "prediction") -> DataFrame:
    """Weighted mean or median of prediction columns; a model with any missing or infinite prediction is left out (M3)."""
    bad = df.agg(*[F.max((F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))).cast("int")).alias(c) for c in weights]).first()
    kept = {c: w for c, w in weights.items() if not bad[c]}
    if not kept:
        return df.withColumn(name, F.lit(None).cast("double"))
    if how == "median":
        return df.withColumn(name, _median([F.col(c) for c in kept]))
    total = sum(kept.values())
    return df.withColumn(name, reduce(lambda a, b: a + b, [F.col(c) * (w / total) for c, w in kept.items()]))


def _median(cols: list):
    a, n = F.array_sort(F.array(*cols)), len(cols)
    return a[n // 2] if n % 2 else (a[n // 2 - 1] + a[n // 2]) / 2


def filled(df: DataFrame, columns: list[str]) -> DataFrame:
    """NULL and NaN become the column's mean, and without any value 0 (M4): of predictions only, never of data."""
    return _with_means(df, _means(df, columns))


def _real(c: str):
    return F.nanvl(F.col(c), F.lit(None).cast("double"))


def _means(df: DataFrame, columns: list[str]) -> dict[str, float]:
    n = F.col(ROWS) if ROWS in df.columns else F.lit(1.0)
    mean = lambda x: F.sum(x * n) / F.sum(F.when(x.isNotNull(), n))
    return df.agg(*[F.coalesce(mean(_real(c)), F.lit(0.0)).alias(c) for c in columns]).first().asDict()  # one row


def _with_means(df: DataFrame, means: dict[str, float]) -> DataFrame:
    return df.withColumns({c: F.coalesce(_real(c), F.lit(m)) for c, m in means.items()})


def stacked(df: DataFrame, features: list[str], target: str, fold: str, fitters: dict, alpha: float = 1.0, with_features: bool = False):
    """Out-of-fold predictions of each fitter, and a ridge on them (M4): (meta model, base models, out-of-fold frame). Predictions
    that are missing become their column's mean. `with_features`: the ridge has the features too. `df` may be `counted`, if all fitters
    heed ROWS as those here do."""
    k = [r[0] for r in df.select(fold).distinct().orderBy(fold).collect()]  # a value a fold
    oof = None
    for i in k:
        part = df.filter(F.col(fold) == i)
        for name, fit in fitters.items():
            part = fit(df.filter(F.col(fold) != i), features, target).transform(part).withColumnRenamed("prediction", name).drop("features")
        oof = part if oof is None else oof.unionByName(part)
    names = list(fitters)
    inputs = names + (list(features) if with_features else [])
    rows = counted(oof, [*inputs, target])  # each row is predicted once
    means = _means(rows, names)
    return ridge(_with_means(rows, means), inputs, target, alpha), {n: fit(df, features, target) for n, fit in fitters.items()}, _with_means(oof, means)


def stacked_predictions(meta: PipelineModel, base: dict[str, PipelineModel], df: DataFrame, name: str = "prediction") -> DataFrame:
    """`df` with the base models' predictions, by name, and the meta model's on them."""
    for n, model in base.items():
        df = predict(model, df).withColumnRenamed("prediction", n).drop("features")
    return predict(meta, filled(df, list(base))).withColumnRenamed("prediction", name).drop("features")


def weights_table(spark, weights: dict[str, float]) -> DataFrame:
    """(model, weight), normalised (M5)."""
    total = sum(weights.values())
    return spark.createDataFrame([(m, w / total) for m, w in weights.items()], "model string, weight double")


def meta_weights(spark: SparkSession, meta: PipelineModel, names: list[str]) -> DataFrame:
    """(model, weight) from a meta model's coefficients of the base models, as shares of their sizes (M5)."""
    size = importance(meta, names)
    return weights_table(spark, size if sum(size.values()) else dict.fromkeys(names, 1.0))


#: Fitters by name (M5): functions of (train, features, target).
FITTERS: dict[str, Callable] = {"ridge": ridge, "boosted": boosted}


def fitter(name: str, **args) -> Callable:
    """A fitter by its name, with parameters (M5)."""
    if name not in FITTERS:
        raise ValueError(f"no model {name}; there are {sorted(FITTERS)}")
    return lambda train, features, target: FITTERS[name](train, features, target, **args)


class Objective(Evaluator):
    """What a search makes as small (or large) as can be (X5): an aggregate of target and prediction."""

    def __init__(self, aggregate: Callable, target: str, larger_is_better: bool = False):
        super().__init__()
        self.aggregate, self.target, self.larger = aggregate, target, larger_is_better

    def _evaluate(self, dataset: DataFrame) -> float:
        return float(dataset.agg(self.aggregate(F.col(self.target), F.col("prediction"))).first()[0])

    def isLargerBetter(self) -> bool:
        return self.larger


def search(train: DataFrame, features: list[str], target: str, grid: dict[str, list], metric: str | Evaluator = "rmse", seed: int = 1):
    """Search of a boosted model's declared space: (best model, history of rows metric and parameters) (M8). `metric` is a name or
    an evaluator of one's own, such as an Objective (X5)."""
    gbt = GBTRegressor(featuresCol="features", labelCol=target, seed=seed)
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(getattr(gbt, name), values)
    maps = builder.build()
    pipe = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip"), gbt])
    tuned = TrainValidationSplit(estimator=pipe, estimatorParamMaps=maps, evaluator=RegressionEvaluator(labelCol=target, metricName=metric) if isinstance(metric, str) else metric, seed=seed, parallelism=2).fit(train)
    history = [{"metric": m} | {p.name: v for p, v in x.items()} for m, x in zip(tuned.validationMetrics, maps, strict=True)]
    return tuned.bestModel, history


@dataclass(frozen=True)
class Between:
    """Numbers from `low` to `high`, both included; `log`: even in their logarithms; `whole`: whole numbers only."""

    low: float
    high: float
    log: bool = False
    whole: bool = False

    def draw(self, rng: random.Random) -> float | int:
        if self.log and self.low <= 0:
            raise ValueError("a logarithmic space begins above 0")
        low, high = (math.log(self.low), math.log(self.high)) if self.log else (self.low, self.high)
        x = rng.uniform(low, high)
        x = min(max(math.exp(x) if self.log else x, self.low), self.high)
        return round(x) if self.whole else x


def draws(space: dict[str, Between | list], n: int, seed: int = 42) -> list[dict]:
    """`n` trials from a declared space: of each parameter a number between bounds, or one of a list."""
    rng = random.Random(seed)
    return [{k: v.draw(rng) if isinstance(v, Between) else rng.choice(v) for k, v in space.items()} for _ in range(n)]


def searched(train: DataFrame, features: list[str], target: str, space: dict[str, Between | list], n: int = 20, fold: str | None = None, folds: int = 3, metric: str | Evaluator = "rmse", seed: int = 42, at_once: int = 2) -> tuple[PipelineModel, DataFrame]:
    """Cross-validated random search over boosted trees (M8): (model of the best trial on all rows, history).

    `fold` names a column 0..folds-1, such as `station_folds` makes, so that no station is on both sides; without it
    rows are dealt at random. history: trial, metric (mean over folds), spread, best, and the parameters as text. Rows with a missing
    feature take part as in `boosted`."""
    trials = draws(space, n, seed)
    pipe = boosted_pipeline(features, target)
    gbt = pipe.getStages()[-1]
    maps = [{getattr(gbt, k): v for k, v in t.items()} for t in trials]
    evaluator = RegressionEvaluator(labelCol=target, metricName=metric) if isinstance(metric, str) else metric
    rows = train.filter(F.col(target).isNotNull())
    cv = CrossValidator(estimator=pipe, estimatorParamMaps=maps, evaluator=evaluator, numFolds=folds, seed=seed, parallelism=at_once, **({"foldCol": fold} if fold else {}))
    tuned = cv.fit(rows.withColumn(fold, F.col(fold).cast("int")) if fold else rows)
    best = (max if evaluator.isLargerBetter() else min)(range(n), key=tuned.avgMetrics.__getitem__)
    history = [(i, float(m), float(s), i == best, {k: str(x) for k, x in t.items()}) for i, (m, s, t) in enumerate(zip(tuned.avgMetrics, tuned.stdMetrics, trials, strict=True))]
    return tuned.bestModel, train.sparkSession.createDataFrame(history, "trial int, metric double, spread double, best boolean, parameters map<string,string>")


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Batch prediction, with a check of the features' names."""
    need = [c for s in model.stages if isinstance(s, VectorAssembler) for c in s.getInputCols() if not c.startswith("__")]
    need += [c for s in model.stages if isinstance(s, SQLTransformer) for c in re.findall(r"CAST\(`([^`]+)` AS DOUBLE\), NULL\) IS NULL", s.getStatement())]
    made = {s.getOutputCol() for s in model.stages if hasattr(s, "getOutputCol")}
    if missing := [c for c in need if c not in df.columns and c not in made]:
        raise ValueError(f"no such columns: {missing}")
    return model.transform(df)


def save_model(spark: SparkSession, model: PipelineModel, path: str, features: list[str], params: dict | None = None) -> None:
    """Saves a model with its features' names and parameters beside it."""
    model.write().overwrite().save(f"{path}/model")
    about = json.dumps({"features": features, "params": params or {}}, default=str)
    spark.createDataFrame([(about,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, list[str], dict]:
    """(model, features, parameters) of a saved model."""
    about = json.loads(spark.read.text(f"{path}/about").first()[0])
    return PipelineModel.load(f"{path}/model"), about["features"], about["params"]


def train_command(df: DataFrame, features: list[str], target: str, path: str, fit=ridge) -> DataFrame:
    """Fits on four fifths, saves the model, and returns its test predictions as y_true, y_pred (M9, M11). `path` must be in a
    folder that all executors share."""
    spark = df.sparkSession
    part = df.withColumn("_p", F.pmod(F.xxhash64(*features, target), F.lit(5)))
    save_model(spark, fit(part.filter("_p > 0"), features, target), path, features)
    model, *_ = load_model(spark, path)
    return model.transform(part.filter("_p = 0")).select(F.col(target).alias("y_true"), F.col("prediction").alias("y_pred"))


def load_data(spark: SparkSession, path: str | None, n: int = 1000) -> DataFrame:
    """Training rows from Parquet, or made-up ones where there is no path."""
    return synthetic(spark, n) if path is None else spark.read.parquet(path)


def synthetic(spark, n: int, features: int = 20, seed: int = 42) -> DataFrame:
    """Gaussian features and a linear target, for trying things out."""
    x = [F.randn(seed + i).alias(f"f{i}") for i in range(features)]
    return spark.range(n).select("id", *x).withColumn("target", F.col("f0") * 3 + F.col("f1") * 2)
