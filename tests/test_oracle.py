"""Each query against its DuckDB equivalent, on the smallest tables."""

import math
import os

import duckdb
import pytest

from nivalis.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{SF}/{t}'")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return repr([norm(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", list(ORACLE))
def test_matches_duckdb(spark, con, name):
    df, want = QUERIES[name](spark, SF), con.sql(ORACLE[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    assert sorted(tuple(norm(r[c]) for c in cols) for r in df.collect()) == sorted(tuple(norm(r[i]) for i in at) for r in want.fetchall())


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLE])
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_models_are_of_use(spark):
    """What has no SQL: errors are below those of saying the mean, stacking isn't worse than its parts, intervals hold the estimate."""
    from pyspark.sql import functions as F

    from nivalis.plans.views import Views

    spread = Views(spark, SF).preds.agg(F.stddev_pop("y_true")).first()[0]
    assert QUERIES["m2_boosted_trees"](spark, SF).first().rmse < 0.8 * spread
    assert QUERIES["m9_train_command"](spark, SF).first().rmse < 0.8 * spread
    by = {r.model: r.rmse for r in QUERIES["m4_stacking"](spark, SF).collect()}
    assert by["stacked"] < 1.05 * min(by["ridge"], by["boosted"])
    whole = QUERIES["a15_metrics"](spark, SF).first()
    for r in QUERIES["a17_bootstrap"](spark, SF).collect():
        assert r.lower <= r.estimate <= r.upper and r.estimate == pytest.approx(whole[r.metric], abs=1e-5)
    s = QUERIES["a29_significance"](spark, SF).first()
    assert 0 <= s.p <= 1 and s.significant == (s.p < 0.05)
