"""Out-of-fold models from second moments against fits on the rows, and limits inside recursive forecasts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkseries.operators import ensembles, forecasts, models, ridge
from sparkseries.operators.windows import TargetHistory


def table(spark, n=240, missing=0.15):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(n, 3)) * [1, 50, 0.01] + [1e4, -3, 0]
    y = x @ [2.0, -0.5, 300.0] + rng.normal(size=n) + 1e3
    rows = []
    for i in range(n):
        values = [None if rng.random() < missing else float(v) for v in x[i]]
        if i % 50 == 7:
            values[0] = float("nan")
        rows.append((i, *values, 4.0, float(y[i]), int(i % 4) - (i % 9 == 0) * (i % 4 + 1)))
    return spark.createDataFrame(rows, "i long, a double, b double, c double, same double, y double, fold int").repartition(3)


@pytest.mark.parametrize("reg", [0.0, 0.7])
def test_as_fits_on_the_rows(spark, reg):
    df, features = table(spark), ["a", "b", "c"]
    out, found = ridge.ridge_cv(df, features, "y", "i", reg=reg)
    want, _ = models.run_cv(df, models.make_pipeline(models.model_factory("linear", "regression", "y", regParam=reg, tol=1e-12), features), "regression", "i", "y")
    got, want = ({r.i: r.pred for r in d.collect()} for d in (out, want))
    assert got.keys() == want.keys() and set(found) == {0, 1, 2, 3}
    assert {i for i, p in got.items() if p is None} == {i for i in range(240) if i % 9 == 0}
    for i, p in want.items():
        assert got[i] == (None if p is None else pytest.approx(p, rel=1e-6)), i


def test_constant_and_collinear_features(spark):
    df = table(spark, missing=0).withColumn("twice", 2 * F.col("b"))
    (one, _), (two, found) = (ridge.ridge_cv(df, f, "y", "i") for f in (["b"], ["b", "twice", "same"]))
    a, b = ({r.i: r.pred for r in d.collect()} for d in (one, two))
    assert all(a[i] == pytest.approx(b[i], rel=1e-8) for i in a if a[i] is not None)
    assert found[0].coefficients[2] == 0


def test_attributions_add_up(spark):
    df = table(spark)
    pred = {r.i: r.pred for r in ridge.ridge_cv(df, ["a", "b", "c"], "y", "i")[0].collect()}
    base = {k: m.intercept + float(np.dot(m.coefficients, m.means)) for k, m in ridge.fold_ridges(df, ["a", "b", "c"], "y", "fold").items()}
    for r in ridge.ridge_attributions(df, ["a", "b", "c"], "y", "fold").collect():
        if r.fold >= 0:
            assert base[r.fold] + r.attr_a + r.attr_b + r.attr_c == pytest.approx(pred[r.i])


def test_few_rows(spark):
    df = spark.createDataFrame([(0, 1.0, 2.0, 0), (1, None, None, 0), (2, 2.0, float("nan"), 1), (3, 5.0, 1.0, None)], "i long, a double, y double, fold int")
    got = {r.i: r.pred for r in ridge.ridge_cv(df, ["a"], "y", "i")[0].collect()}
    assert got == {0: None, 1: None, 2: None, 3: None}
    df = df.withColumn("fold", F.coalesce("fold", F.lit(1)))
    assert {r.i: r.pred for r in ridge.ridge_cv(df, ["a"], "y", "i")[0].collect()} == {0: 1.0, 1: 1.0, 2: 2.0, 3: 2.0}
    assert ridge.ridge_cv(df.filter("i < 0"), ["a"], "y", "i")[0].count() == 0
    stacked = ensembles.stack(table(spark, missing=0), ["a", "b"], "y", "i")
    assert stacked.filter("pred is null").count() == 27


def test_limits_inside_the_recursion(spark):
    model = forecasts.LinearHistoryModel((1,), (), False, [-0.8], 5.0)
    history = spark.createDataFrame([("s", 0, 100.0)], "s string, t long, y double")
    future = spark.createDataFrame([("s", t) for t in range(1, 5)], "s string, t long")

    def told(out):
        return [r.pred for r in out.orderBy("t").collect()]

    run = lambda low, high: told(forecasts.recursive_forecast(model, history, future, "y", "t", "s", low, high))
    assert run(0.0, None) == pytest.approx([0, 5, 1, 4.2])
    assert run(None, 50.0) == pytest.approx([-75, 50, -35, 33])
    assert run(None, None) == pytest.approx([-75, 65, -47, 42.6])
    predict = lambda rows: rows.withColumn("pred", 5 - 0.8 * F.col("y_lag_1"))
    builder = TargetHistory("y", "t", "s", [1])
    assert told(forecasts.forecast_any(predict, history, future, builder, "t", "s", low=0.0)) == pytest.approx([0, 5, 1, 4.2])
    # on another scale limits are taken after the inverse only
    other = forecasts.LinearHistoryModel((1,), (), False, [0.0], -60.0, difference=1)
    past = spark.createDataFrame([("s", -1, 100.0), ("s", 0, 100.0)], "s string, t long, y double")
    assert told(forecasts.recursive_forecast(other, past, future, "y", "t", "s", low=0.0)) == pytest.approx([40, 0, 0, 0])
