"""Recursive forecasts with any model on differences and logarithms, forecasts from the whole history, balanced group folds."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from sparkseries.operators import folds, forecasts
from sparkseries.operators.windows import TargetHistory


def trees(builder):
    """Boosted trees as the ``fit`` of a backtest."""
    vectors = VectorAssembler(inputCols=builder.names, outputCol="features")

    def fit(rows):
        model = GBTRegressor(labelCol=builder.target, maxIter=5, maxDepth=3).fit(vectors.transform(rows))
        return lambda now: model.transform(vectors.transform(now)).withColumnRenamed("prediction", "pred")

    return fit


def test_trees_on_differences_follow_a_trend(spark):
    df = spark.createDataFrame([("a", t, 3 + 0.8 * t) for t in range(60)], "s string, t int, y double")
    builder = TargetHistory("y", "t", "s", [1, 2])
    mae = {}
    for difference in (0, 1):
        out = forecasts.backtest_any(trees(builder), df, builder, "t", "s", [54], 4, difference=difference).collect()
        assert len(out) == 4 and {r.step for r in out} == {1, 2, 3, 4}
        mae[difference] = sum(abs(r.pred - r.target) for r in out) / 4
    assert mae[0] > 0.5 and mae[1] < 0.01


@pytest.mark.parametrize("difference,log_offset", [(0, None), (1, None), (7, None), (0, 0.5), (7, 0.5)])
def test_as_the_linear_recursion(spark, difference, log_offset):
    rng = random.Random(difference)
    rows = [(s, t, math.exp(0.01 * t + 0.2 * math.sin(t) + 0.05 * rng.random() + k)) for k, s in enumerate("ab") for t in range(40)]
    df = spark.createDataFrame(rows, "s string, t int, y double")
    history, future = df.filter("t < 37"), df.filter("t >= 37")
    model = forecasts.fit_linear_history(history, "y", "t", "s", [1, 2], [3], False, difference, log_offset=log_offset)
    builder = TargetHistory("y", "t", "s", [1, 2], [3])

    def predict(now):
        pred = F.lit(model.intercept)
        for n, b in zip(builder.names, model.coefficients, strict=True):
            pred = pred + F.lit(b) * F.col(n)
        return now.withColumn("pred", pred)

    for low, high in ((None, None), (1.5, 3.0)):
        want = {(r.s, r.t): r.pred for r in forecasts.recursive_forecast(model, history, future, "y", "t", "s", low, high).collect()}
        got = {(r.s, r.t): r.pred for r in forecasts.forecast_any(predict, history, future, builder, "t", "s", low, high, difference, log_offset).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)


def test_future_by_the_mean_of_fold_models(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([("a", t, 5 + math.sin(t) + rng.random()) for t in range(60)], "s string, t int, y double")
    future = spark.createDataFrame([("a", t) for t in range(60, 64)], "s string, t int")
    made = [[r.pred for r in forecasts.recursive_forecast(forecasts.fit_linear_history(df.filter(F.col("t") < c), "y", "t", "s", [1, 2]), df, future, "y", "t", "s").orderBy("t").collect()] for c in (40, 50, 60)]
    mean = forecasts.forecast_future(df, future, "y", "t", "s", {"lags": [1, 2]}, [40, 50]).orderBy("t").collect()
    assert [r.pred for r in mean] == pytest.approx([(a + b) / 2 for a, b in zip(*made[:2], strict=True)]) and [r.step for r in mean] == [1, 2, 3, 4]
    assert [r.pred for r in forecasts.forecast_future(df, future, "y", "t", "s", {"lags": [1, 2]}).orderBy("t").collect()] == pytest.approx(made[2])


def mixed_groups(n: int = 60) -> list[tuple]:
    rng = random.Random(5)
    rows = []
    for g in range(n):
        shares = [rng.random() ** 3 for _ in range(3)]
        for _ in range(rng.randint(1, 30)):
            rows.append((f"g{g}" if g else None, rng.choices(["x", "y", None], shares)[0]))
    return rows


def test_balanced_groups(spark):
    rows = mixed_groups()
    df = spark.createDataFrame(rows, "g string, c string").withColumn("fold", F.lit("clash"))
    out = folds.balanced_group(df, "g", "c", 4).collect()
    assert len(out) == len(rows) and out[0].asDict().keys() == {"g", "c", "fold"}
    of = {}
    for r in out:
        assert of.setdefault(r.g, r.fold) == r.fold
    groups, classes = sorted({g or "" for g, _ in rows}), [None, "x", "y"]
    counts = np.array([[sum((g or "") == k and c == x for g, c in rows) for x in classes] for k in groups], float)
    loads, want = np.zeros((4, 3)), {}
    # the same rule without arrays
    for i in sorted(range(len(groups)), key=lambda i: -counts[i].std()):
        score = []
        for k in range(4):
            loads[k] += counts[i]
            score.append((round(float(np.mean([np.std(loads[:, c] / max(1, counts[:, c].sum())) for c in range(3)])), 12), loads[k].sum() - counts[i].sum(), k))
            loads[k] -= counts[i]
        loads[min(score)[2]] += counts[i]
        want[groups[i]] = min(score)[2]
    assert {g or "": k for g, k in of.items()} == want
    spread = lambda kept: max(np.std([sum(kept[g] == k and c == x for g, c in rows) / sum(c == x for _, c in rows) for k in range(4)]) for x in classes)
    turns = {r.g: r.fold for r in folds.stratified_group(df.drop("fold").na.fill("none").withColumnRenamed("c", "d"), "g", "d", 4).collect()}
    turns[None] = turns["none"]
    assert spread(of) < 0.03 < spread(turns)


def test_balanced_groups_in_parts(spark):
    df = spark.createDataFrame(mixed_groups(400), "g string, c string")
    out = folds.balanced_group(df, "g", "c", 4, part_groups=100).groupBy("c", "fold").count().collect()
    for c in ("x", "y", None):
        n = [r["count"] for r in out if r.c == c]
        assert len(n) == 4 and max(n) - min(n) < 0.08 * sum(n)
    assert folds.balanced_group(df.filter("g = 'nothing'"), "g", "c").count() == 0
