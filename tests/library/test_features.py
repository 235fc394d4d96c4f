"""Transforms, scalers, encoders, profiles, joins, metrics, folds, forecasts."""

import math

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from sparkseries.operators import categorical, dates, ensembles, folds, forecasts, joins, metrics, models, numeric, profile, reshape, windows
from sparkseries.sources import files


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_gates_of_numeric_transforms(spark):
    df = spark.createDataFrame([(1, -1.0), (2, 0.0), (3, 4.0)], "i long, x double")
    assert rows(numeric.Logarithm("x", 2).transform(df), "i") == [(1, None), (2, None), (3, 2.0)]
    assert rows(numeric.SquareRoot("x").transform(df), "i") == [(1, None), (2, 0.0), (3, 2.0)]
    assert rows(numeric.Reciprocal("x").transform(df), "i") == [(1, -1.0), (2, None), (3, 0.25)]


@pytest.mark.parametrize("scaler", [numeric.MinMaxScaler, numeric.RobustScaler, numeric.MeanNormalizer, numeric.MaxAbsScaler])
def test_scalers_learn_from_training_only_and_come_back(spark, scaler):
    train = spark.createDataFrame([(float(v), 5.0) for v in (1, 2, 4, 9)], "x double, c double")
    test = spark.createDataFrame([(100.0, 5.0)], "x double, c double")
    model = scaler(["x", "c"]).fit(train)
    one = model.transform(test).first()
    both = [r for r in model.transform(test.union(spark.createDataFrame([(1e9, 1.0)], "x double, c double"))).collect() if r.x == one.x]
    assert len(both) == 1 and math.isfinite(one.c)
    assert model.inverse_transform(model.transform(test)).first().x == pytest.approx(100)


@pytest.mark.parametrize("method", ["box-cox", "yeo-johnson"])
def test_power_transform_finds_the_exponent(spark, method):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(float(v),) for v in np.exp(rng.normal(size=2000))], "x double")
    model = numeric.PowerTransformer("x", method).fit(df)
    if method == "box-cox":
        assert abs(model.lambdas["x"]) < 0.1
    back = model.inverse_transform(model.transform(df))
    assert back.agg(F.sum("x")).first()[0] == pytest.approx(df.agg(F.sum("x")).first()[0])


def _exponent(x, method, passes=5, points=17):
    """The grid search on the values themselves, in extended precision about their mean logarithm (values of one sign) or as they are."""
    x, (lo, hi) = x.astype(np.longdouble), (-5.0, 5.0)
    logs = np.log(x) if method == "box-cox" else np.sign(x) * np.log1p(np.abs(x))
    for _ in range(passes):
        grid = [lo + (hi - lo) * k / (points - 1) for k in range(points)]
        score = []
        for lam in grid:
            up = logs >= 0
            one = method == "box-cox" or up.all() or not up.any()
            c = np.abs(logs).mean() * np.sign(logs[0]) if one and method != "box-cox" else logs.mean() if one else 0
            u = np.abs(logs) - abs(c) if method != "box-cox" else logs - c
            e = np.where(up, lam, 2 - lam) if method != "box-cox" else np.full(len(x), lam)
            y = np.where(e == 0, u, np.expm1(e * u) / np.where(e == 0, 1, e)) * (1 if method == "box-cox" else np.where(up, 1, -1))
            v = np.log(y.var()) + (2 * e[0] * (c if method == "box-cox" else abs(c)) if one else 0)
            score.append(-0.5 * len(x) * v + (lam - 1) * logs.sum())
        k = int(np.argmax(score))
        lo, hi = grid[max(0, k - 1)], grid[min(points - 1, k + 1)]
    return (lo + hi) / 2


def test_power_transform_of_large_and_mixed_values(spark):
    rng = np.random.default_rng(7)
    values = {"large": 1e6 + rng.gamma(2, 1e5, 3000), "mixed": rng.normal(size=3000) * 3 - 1, "negative": -rng.gamma(2, 9, 3000), "price": 900 + rng.random(3000) * 1e5}
    rows = spark.createDataFrame([tuple(float(v[i]) for v in values.values()) for i in range(3000)], ", ".join(f"{c} double" for c in values)).withColumns({"same": F.lit(3.1), "none": F.lit(None).cast("double")})
    found = numeric.PowerTransformer([*values, "same", "none"]).fit(rows).lambdas
    assert {c: found[c] for c in values} == {c: pytest.approx(_exponent(v, "yeo-johnson"), abs=1e-9) for c, v in values.items()}
    assert found["same"] == found["none"]  # no spread, no exponent better than another
    positive = numeric.PowerTransformer(["large", "price"], "box-cox").fit(rows).lambdas
    assert positive == {c: pytest.approx(_exponent(values[c], "box-cox"), abs=1e-9) for c in ("large", "price")}
    with pytest.raises(ValueError, match="mixed"):
        numeric.PowerTransformer(["price", "mixed"], "box-cox").fit(rows)


def test_encoders(spark):
    df = spark.createDataFrame([(0, "banana", 1.0), (1, "apple", 3.0), (2, "cherry", 10.0), (3, "apple", 5.0)], "i long, c string, y double")
    new = spark.createDataFrame([(9, "fig", 0.0)], "i long, c string, y double")
    ordinal = categorical.OrdinalEncoder("c").fit(df)
    assert [r.c for r in ordinal.transform(df).orderBy("i").collect()] == [1, 0, 2, 0] and ordinal.transform(new).first().c is None
    assert [r.c for r in categorical.TargetOrdinalEncoder("c", "y").fit(df).transform(df).orderBy("i").collect()] == [0, 1, 2, 1]
    mean = categorical.TargetEncoder("c", "y").fit(df)
    assert mean.transform(df).filter("i = 1").first().c == 4.0 and mean.transform(new).first().c == 4.75
    rare = categorical.RareGrouper("c", min_frequency=2).fit(df)
    assert [r.c for r in rare.transform(df).orderBy("i").collect()] == ["Other", "apple", "Other", "apple"] and rare.transform(new).first().c == "Other"
    hot = categorical.OneHotEncoder("c", min_frequency=2).fit(df).transform(df.union(new)).orderBy("i").collect()
    assert [(r.c_apple, r.c_infrequent) for r in hot] == [(0, 1), (1, 0), (0, 1), (1, 0), (0, 0)]


def test_crossfit_encoding_never_uses_the_rows_own_fold(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], i % 3, float(i)) for i in range(12)], "i long, c string, f int, y double")
    a = categorical.TargetEncoder("c", "y").fit_transform(df, "f")
    changed = df.withColumn("y", F.when(F.col("f") == 0, F.lit(1e6)).otherwise(F.col("y")))
    b = categorical.TargetEncoder("c", "y").fit_transform(changed, "f")
    assert rows(a.filter("f = 0").select("i", "c"), "i") == rows(b.filter("f = 0").select("i", "c"), "i")
    want = {(c, f): np.mean([i for i in range(12) if "ab"[i % 2] == c and i % 3 != f]) for c in "ab" for f in range(3)}
    assert all(r.c == pytest.approx(want["ab"[r.i % 2], r.f]) for r in a.collect())


def test_pipeline_of_steps(spark):
    df = spark.createDataFrame([(i, float(i + 1), "xyz"[i % 3]) for i in range(30)], "t long, x double, c string")
    out = Pipeline(stages=[numeric.Logarithm("x"), windows.LagFeatures("x", [1], "t"), categorical.OrdinalEncoder("c"), dates.Cyclical("t", 7), reshape.DropColumns("t")]).fit(df).transform(df)
    assert set(out.columns) == {"x", "c", "x_lag_1", "t_sin", "t_cos"}
    with pytest.raises(TypeError):
        reshape.ModelInput(["c"]).transform(df)


def test_profiles(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y"), (None, "z")], "a long, b string")
    one = profile.table_profile(df).first()
    assert (one.n_rows, one.n_columns, one.duplicated_rows, one.missing_columns, one.missing_cells) == (4, 2, 1, 1, 1)
    got = {r.column: r for r in profile.column_profile(df).collect()}
    assert got["a"].n_unique == 3 and got["b"].mode == "x" and got["b"].mode_rate == 0.5 and got["a"].median == 1
    empty = profile.table_profile(df.limit(0)).first()
    assert empty.n_rows == 0 and empty.missing_rate is None
    pairs = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (None, 6.0), (4.0, None)], "x double, y double")
    assert [(r.excluded, round(r.r, 9)) for r in profile.correlation_matrix(pairs, ["x", "y"]).collect()] == [(2, 1.0)] * 4
    constant = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert profile.pairwise_correlation(constant, ["x", "y"]).first().r is None


def test_calendar(spark):
    df = spark.sql("SELECT CAST(d AS TIMESTAMP_NTZ) AS d FROM VALUES ('2020-01-01'), ('2020-01-02'), ('2020-01-02'), ('2020-01-05') t(d)")
    one = profile.calendar_summary(df, "d").first()
    assert (one.expected_days, one.missing_days, one.duplicated_rows) == (5, 2, 2)
    assert [str(r.day) for r in joins.missing_days(df, "d").orderBy("day").collect()] == ["2020-01-03", "2020-01-04"]


def test_join_checks(spark):
    left, right = spark.createDataFrame([(1,), (2,)], "k long"), spark.createDataFrame([(1, "a"), (1, "b")], "k long, v string")
    with pytest.raises(ValueError):
        joins.left_join_checked(left, right, ["k"])
    assert rows(joins.left_join_checked(left, right.limit(1), ["k"]), "k") == [(1, "a"), (2, None)]


def test_binary_metrics(spark):
    df = spark.createDataFrame(list(zip([0, 0, 1, 1, 1, 0], [0.1, 0.6, 0.7, 0.4, 0.9, 0.2], strict=True)), "y int, p double").withColumn("label", metrics.binary_label("p"))
    cells = {(r.actual, r.predicted): r.n for r in metrics.confusion(df, "y", "label", [0, 1]).collect()}
    assert cells == {(0, 0): 2, (0, 1): 1, (1, 0): 1, (1, 1): 2}
    one = metrics.ranking_scores(df, "y", "p", max_fpr=1.0).first()
    assert one.roc_auc == pytest.approx(8 / 9) and one.pauc == pytest.approx(8 / 9) and one.average_precision == pytest.approx((1 + 1 + 3 / 4) / 3)
    tied = spark.createDataFrame([(0, 0.5), (1, 0.5)], "y int, p double")
    assert metrics.ranking_scores(tied, "y", "p").first().roc_auc == 0.5
    assert metrics.get_metric("pauc@0.2")[1] == {"max_fpr": 0.2}
    with pytest.raises(ValueError):
        metrics.get_metric("rmse", "binary")


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (5.0, 2.0)], "y double, p double")
    one = metrics.regression_scores(df, "y", "p").first()
    assert (one.mae, one.mse) == (pytest.approx(4 / 3), pytest.approx(10 / 3)) and one.r2 == pytest.approx(1 - 10 / 8)
    with pytest.raises(Exception, match="negative"):
        df.withColumn("y", F.lit(-1.0)).agg(metrics.rmsle("y", "p")).collect()


def test_folds_are_partitions(spark):
    df = spark.createDataFrame([(i, i % 24, "ab"[i % 5 == 0]) for i in range(240)], "i long, g long, c string")
    for out in (folds.kfold(df, "i", 4), folds.kfold(df, "i", 4, shuffle=True), folds.stratified(df, "i", "c", 4), folds.group_fold(df, "g", 4), folds.stratified_group(df, "g", "c", 4)):
        got = out.select("i", "fold").collect()
        assert sorted(r.i for r in got) == list(range(240)) and {r.fold for r in got} == {0, 1, 2, 3}
    by_group = folds.group_fold(df, "g", 4).groupBy("g").agg(F.count_distinct("fold").alias("n"))
    assert by_group.agg(F.max("n")).first()[0] == 1
    split = folds.time_series_split(df, "i", 3, gap=2)
    ends = {r.fold: (r.a, r.b) for r in split.groupBy("fold").agg(F.max(F.when(F.col("role") == "train", F.col("i"))).alias("a"), F.min(F.when(F.col("role") == "valid", F.col("i"))).alias("b")).collect()}
    assert ends == {0: (57, 60), 1: (117, 120), 2: (177, 180)}
    with pytest.raises(ValueError):
        folds.check_config("kfold", "time_series")


def test_forecast_ignores_future_targets_and_follows_the_rule(spark):
    rows_ = [(s, t, float(b + 2 * t)) for s, b in (("A", 10), ("B", 100)) for t in range(40)]
    df = spark.createDataFrame(rows_, "s string, t long, y double")
    history, future = df.filter("t < 30"), df.filter("t >= 30")
    model = forecasts.fit_linear_history(history, "y", "t", "s", lags=[1, 2])
    a = rows(forecasts.recursive_forecast(model, history, future, "y", "t", "s"), "s", "t")
    b = rows(forecasts.recursive_forecast(model, history, future.withColumn("y", F.lit(-1.0)), "y", "t", "s"), "s", "t")
    assert a == b
    assert [r[3] for r in a] == pytest.approx([float(b + 2 * t) for b in (10, 100) for t in range(30, 40)], abs=1e-2)
    with pytest.raises(ValueError):
        forecasts.recursive_forecast(model, history, df, "y", "t", "s")


def test_forecast_step_by_step_with_any_model(spark):
    df = spark.createDataFrame([(s, t, float(b + 2 * t)) for s, b in (("A", 10), ("B", 100)) for t in range(12)], "s string, t long, y double")
    history, future = df.filter("t < 9"), df.filter("t >= 9")
    builder = windows.TargetHistory("y", "t", "s", [1, 2])
    next_on_the_line = lambda rows_: rows_.withColumn("pred", 2 * F.col("y_lag_1") - F.col("y_lag_2"))
    out = forecasts.forecast_any(next_on_the_line, history, future, builder, "t", "s")
    assert [(r.s, r.t, r.pred) for r in out.orderBy("s", "t").collect()] == [(s, t, float(b + 2 * t)) for s, b in (("A", 10), ("B", 100)) for t in range(9, 12)]


def test_out_of_fold_models_and_blends(spark):
    rng = np.random.default_rng(2)
    data = [(i, float(a), float(b), float(2 * a + b), int(a + b > 0), i % 3) for i, (a, b) in enumerate(rng.normal(size=(150, 2)))]
    df = spark.createDataFrame(data, "i long, a double, b double, y double, z int, fold int")
    out, fitted = models.run_cv(df, models.make_pipeline(models.model_factory("linear", "regression", "y"), ["a", "b"]), "regression", "i", "y")
    assert out.count() == 150 and out.agg(metrics.rmse("y", "pred")).first()[0] < 1e-6 and set(fitted) == {0, 1, 2}
    binary, _ = models.run_cv(df, models.make_pipeline(models.model_factory("linear", "binary", "z"), ["a", "b"]), "binary", "i", "z")
    assert metrics.ranking_scores(binary, "z", "pred").first().roc_auc > 0.95
    dummy, _ = models.run_cv(df, models.make_pipeline(models.model_factory("dummy", "regression", "y"), ["a"]), "regression", "i", "y")
    members = ensembles.join_members({"lin": out.withColumnRenamed("i", "key"), "mean": dummy.withColumnRenamed("i", "key")}, keep=("y", "fold"))
    assert ensembles.best_weights(members, ["lin", "mean"], "y", 10)[0] == (1.0, 0.0)
    blend = ensembles.cross_fit_blend(members, ["lin", "mean"], "y", "fold", 10)
    assert blend.agg(metrics.rmse("y", "pred")).first()[0] < 1e-6
    best, trials = models.tune(lambda p: (p["x"] - 3) ** 2, {"x": ("float", 0.0, 10.0), "k": ("int", 1, 5)}, 30)
    assert abs(best["x"] - 3) < 1 and len(trials) == 30


def test_boosted_trees_stop_early_and_are_refitted(spark):
    rng = np.random.default_rng(4)
    data = [(i, float(a), float((a > 0) + n), i % 3) for i, (a, n) in enumerate(rng.normal(size=(180, 2)))]
    df = spark.createDataFrame(data, "i long, a double, y double, fold int")
    pipeline = models.make_pipeline(models.model_factory("gbt", "regression", "y", maxIter=15, maxDepth=4, stepSize=0.5), ["a"])
    out, fitted = models.run_cv(df, pipeline, "regression", "i", "y", early=True)
    trees = [len(m.stages[-1].treeWeights) for m in fitted.values()]
    assert out.filter("pred is not null").count() == 180 and max(trees) < 15
    for k, m in fitted.items():
        held = df.filter(F.col("fold") == k)
        alone = pipeline.fit(df.filter(F.col("fold") != k)).stages[-1]
        ready = m
        for_held = ready.stages[1].transform(ready.stages[0].transform(held))
        loss = models.training_history(alone, for_held)
        assert len(loss) == 15 and loss[len(m.stages[-1].treeWeights) - 1] <= loss[-1]
    again = models.refit(df, pipeline, fitted)
    assert len(again.stages[-1].treeWeights) == models.best_iteration(fitted) == max(1, round(sum(trees) / 3))
    assert models.predict_test(df, "regression", "i", refit=again).count() == 180
    with pytest.raises(ValueError):
        models.fit_early(models.make_pipeline(models.model_factory("linear", "regression", "y"), ["a"]), df, df)


def test_folds_read_their_table_once(spark):
    data = [(i, float(i % 9), float(i % 9 > 4), i % 2) for i in range(60)]
    read = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(v):
        read.add(1)
        return v

    df = spark.createDataFrame(data, "i long, a double, y double, fold int").withColumn("a", counted("a"))
    pipeline = models.make_pipeline(models.model_factory("gbt", "regression", "y", maxIter=2, maxDepth=2), ["a"])
    out, _ = models.run_cv(df, pipeline, "regression", "i", "y", early=True)
    assert out.filter("pred is not null").count() == 60 and read.value == 60


@pytest.mark.parametrize("difference", [0, 1, 7])
def test_forecasts_of_logarithms(spark, difference):
    n = 60
    y = [math.exp(0.02 * t + 0.3 * math.sin(2 * math.pi * t / 7)) - 0.5 for t in range(n)]
    df = spark.createDataFrame([("a", t, v) for t, v in enumerate(y)], "s string, t int, y double")
    model = forecasts.fit_linear_history(df.filter("t < 50"), "y", "t", "s", lags=[1, 2, 7], difference=difference, log_offset=0.5)
    got = [r.pred for r in forecasts.recursive_forecast(model, df.filter("t < 50"), df.filter("t >= 50").select("s", "t"), "y", "t", "s").orderBy("step").collect()]
    logs, want = [math.log(v + 0.5) for v in y[:50]], []
    for _ in range(10):
        z = [b - a for a, b in zip(logs, logs[difference:])] if difference else logs
        step = model.intercept + sum(b * z[-k] for b, k in zip(model.coefficients, [1, 2, 7]))
        logs.append(step + logs[-difference] if difference else step)
        want.append(math.exp(logs[-1]) - 0.5)
    assert got == pytest.approx(want, rel=1e-9) and got == pytest.approx(y[50:], rel=0.05)
    first = forecasts.one_step(model, df, "y", "t", "s").filter("t = 50").first()
    assert first.pred_one_step == pytest.approx(got[0], rel=1e-9)
    with pytest.raises(ValueError, match="no logarithm"):
        forecasts.fit_linear_history(df.withColumn("y", F.col("y") - 100), "y", "t", "s", log_offset=0.5)


def test_files(spark, tmp_path):
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    folder = tmp_path / "csv"
    folder.mkdir()
    (folder / "a.csv").write_bytes("時刻,気温\n2016/1/1 0:00,1.5\n2016/1/1 1:00,*\n".encode("cp932"))
    assert files.detect_encodings(spark, str(folder)).first().encoding == "cp932"
    df = files.read_csv(spark, str(folder / "a.csv"))
    assert dict(df.dtypes) == {"時刻": "timestamp_ntz", "気温": "double"} and df.filter("`気温` is null").count() == 1
    kept = files.materialize(spark, str(folder / "a.csv"), str(tmp_path / "kept"))
    assert kept.count() == 2 and files.materialize(spark, str(folder / "a.csv"), str(tmp_path / "kept")).count() == 2
    listed = files.list_files(spark, str(folder), "*.csv")
    assert [r.name for r in files.query_files(listed, "a*", [".csv"], page=9).collect()] == ["a.csv"]
    report = files.profile_files(spark, [str(folder / "a.csv"), str(tmp_path / "none.csv")]).collect()
    assert [r.error is None for r in report] == [True, False]
    files.write_predictions(spark.createDataFrame([(1, float("nan"))], "i long, pred double"), str(tmp_path / "runs/1/oof.parquet"), "i")
    assert files.read_predictions(spark, runs=str(tmp_path / "runs")).first().pred is None
