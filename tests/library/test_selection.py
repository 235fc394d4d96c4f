"""Blends by any metric, searches that stop, and the choice of a model, against plain versions."""

import dataclasses

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkseries.operators import ensembles, metrics, models, selection


def rows(spark, n=200):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, 2))
    y = x @ [1.0, -2.0] + rng.normal(size=n)
    data = [(i, float(x[i, 0]), float(x[i, 1]), float(y[i]), int(y[i] > 0), i % 4, float(y[i] + rng.normal()), float(-y[i] / 3 + rng.normal() * 2), float(rng.random())) for i in range(n)]
    return spark.createDataFrame(data, "key long, a double, b double, y double, z int, fold int, p1 double, p2 double, p3 double").repartition(3)


def plain(metric: str, y, p) -> float:
    y, p = np.asarray(y), np.asarray(p)
    if metric == "mae":
        return float(np.abs(y - p).mean())
    if metric == "roc_auc":
        a, b = p[y == 1], p[y == 0]
        return float(((a[:, None] > b[None]) + 0.5 * (a[:, None] == b[None])).mean())
    if metric == "accuracy":
        return float(((p >= 0.5) == (y == 1)).mean())
    hit = p >= 0.5
    return float(2 * (hit & (y == 1)).sum() / (hit.sum() + (y == 1).sum()))


@pytest.mark.parametrize("metric,target", [("mae", "y"), ("roc_auc", "z"), ("accuracy", "z"), ("f1", "z")])
def test_weights_by_a_metric(spark, metric, target):
    df, names = rows(spark), ["p1", "p2", "p3"]
    data = df.toPandas()
    sign = 1 if metrics.get_metric(metric)[0].greater else -1
    blend, w = ensembles.blend_by_metric(df, names, target, metric)
    assert min(w) >= 0 and sum(w) == pytest.approx(1)
    got = plain(metric, data[target], data[names].to_numpy() @ np.array(w))
    every = [plain(metric, data[target], data[names].to_numpy() @ np.array(v)) for v in ensembles.weight_grid(3, 4)]
    assert sign * got >= max(sign * s for s in every) - 1e-12
    assert metrics.score_by(blend.withColumn("g", F.lit(0)), target, "pred", metric, ["g"]).first()["score"] == pytest.approx(got)
    crossed = ensembles.cross_fit_by_metric(df, names, target, "fold", metric, rounds=2).toPandas()
    for k in range(4):
        out = data[data.fold != k]
        best = ensembles.metric_weights(df.filter(F.col("fold") != k), names, target, metric, rounds=2)[0]
        assert best[1] == pytest.approx(plain(metric, out[target], out[names].to_numpy() @ np.array(best[0])))
        own = crossed[crossed.fold == k]
        assert own["pred"].to_numpy() == pytest.approx(own[names].to_numpy() @ np.array(best[0]))


@pytest.mark.parametrize("metric", ["pr_auc", "pauc@0.3", "mcc", "g_mean", "precision", "recall_macro", "f1_weighted", "logloss", "roc_auc_micro"])
def test_every_metric_has_a_score(spark, metric):
    df = rows(spark).withColumn("p", F.least(F.greatest(0.5 + F.col("p1") / 9, F.lit(0.01)), F.lit(0.99)))
    got = {r["fold"]: r["score"] for r in metrics.score_by(df, "z", "p", metric, ["fold"]).collect()}
    assert set(got) == {0, 1, 2, 3} and all(v is not None and 0 <= abs(v) <= 5 for v in got.values())


def test_search_stops_what_is_worse_than_the_median():
    calls: list[tuple] = []

    def objective(params, fold):
        calls.append((params["x"], fold))
        return (params["x"] - 0.3) ** 2 + 0.001 * fold

    best, table = models.tune_by_folds(objective, {"x": ("float", 0.0, 1.0)}, 12, [0, 1, 2, 3], seed=5)
    again = models.tune_by_folds(objective, {"x": ("float", 0.0, 1.0)}, 12, [0, 1, 2, 3], seed=5)
    assert (best, table) == again
    done = {r["trial"]: r for r in table}
    assert len(done) == 12 and best["x"] == min((r["params"]["x"] for r in table), key=lambda x: (x - 0.3) ** 2)
    assert all(r["rungs"] == (4 if r["state"] == "complete" else len(r["scores"])) for r in table)
    stopped = [r for r in table if r["state"] == "stopped"]
    assert stopped and all(r["rungs"] < 4 for r in stopped) and len(calls) // 2 == sum(r["rungs"] for r in table) < 48
    # the first rung keeps what is no worse than the median of the others
    first = {k: r["scores"][0] for k, r in done.items()}
    for k, r in done.items():
        others = sorted(v for j, v in first.items() if j != k)
        assert (r["rungs"] > 1) == (first[k] <= np.median(others))
    greater = models.tune_by_folds(lambda p, f: -objective(p, f), {"x": ("float", 0.0, 1.0)}, 12, [0, 1, 2, 3], greater=True, seed=5)
    assert greater[0] == best and [r["trial"] for r in greater[1]] == [r["trial"] for r in table]
    assert all(r["state"] == "complete" for r in models.tune_by_folds(objective, {"x": ("float", 0, 1)}, 3, [0, 1])[1])


def test_selection(spark):
    df = rows(spark)
    members = [selection.ridge_member("both", ["a", "b"], metric="mae", space={"reg": ("float", 0.01, 10.0, "log")}, trials=5), selection.ridge_member("one", ["a"], metric="mae"), selection.model_member("none", "dummy", ["a"], metric="mae")]
    out = selection.select_model(df, members, ["mean", "weighted", "stacking"])
    table = {r["name"]: r for r in out.summary.collect()}
    data = out.predictions.toPandas()
    assert set(table) == {"both", "one", "none", "mean", "weighted", "stacking"} and len(data) == 200
    for n, r in table.items():
        assert r["score"] == pytest.approx(plain("mae", data["y"], data[n])) and r["rank"] == 1 + sum(x["score"] < r["score"] for x in table.values())
    assert [n for n, r in table.items() if r["chosen"]] == [out.chosen] and table[out.chosen]["rank"] == 1
    assert {r["state"] for r in out.trials["both"]} <= {"complete", "stopped"} and 0.01 <= out.params["both"]["reg"] <= 10
    assert out.trials["one"] == []
    alone = selection.select_model(df, members[1:2])
    assert [(r["kind"], r["name"], r["chosen"]) for r in alone.summary.collect()] == [("member", "one", True)]


def test_selection_of_classes(spark):
    df = rows(spark)
    common = {"task": "binary", "target": "z", "metric": "roc_auc"}
    members = [selection.model_member("a", "linear", ["a"], **common), selection.model_member("b", "linear", ["b"], **common)]
    out = selection.select_model(df, members, ["mean", "rank_mean"])
    data = out.predictions.toPandas()
    for r in out.summary.collect():
        assert r["score"] == pytest.approx(plain("roc_auc", data["z"], data[r["name"]]))


@pytest.mark.parametrize(
    "change,methods,message",
    [({"fold": "other"}, ["mean"], "differ in .*fold"), ({"metric": "rmse"}, ["mean"], "differ in .*metric"), ({"data": "test"}, ["mean"], "differ in .*data"), ({"name": "a"}, ["mean"], "share names"), ({}, ["rank_mean"], "two classes"), ({}, ["vote"], "none of"), ({"target": "b", "fold": "c"}, ["mean"], "fold.*target")],
)
def test_inconsistent_members_are_refused_before_training(change, methods, message):
    def never(df, params):
        raise AssertionError("trained")

    a = selection.Member("a", never, metric="mae")
    b = selection.Member(**{"name": "b", "oof": never, "metric": "mae", **change})
    with pytest.raises(ValueError, match=message):
        selection.select_model(None, [a, b], methods)


def test_members_of_no_kind_are_refused():
    for members in ([], [selection.Member("a", None, task="multiclass", metric="logloss")], [selection.Member("a", None, metric="roc_auc")]):
        with pytest.raises(ValueError):
            selection.check_members(members)


def test_learning_curve_over_the_most_recent_rows(spark):
    """A series whose level jumps: a dummy fitted on the latest half of the training rows knows the new level only."""
    df = spark.createDataFrame([(t, 0.0 if t < 40 else 10.0, int(t >= 60) - int(t < 60)) for t in range(80)], "key long, y double, fold int")
    mae = lambda rows: rows.agg(F.avg(F.abs(F.col("y") - F.col("prediction")))).first()[0]
    model = models.Dummy("y")
    out = {r.share: r for r in models.learning_curve(df.withColumn("fold", F.when(F.col("key") >= 60, 0).otherwise(-1)), model, "y", "key", [0.33, 1.0], mae, time="key").collect()}
    assert out[0.33].valid_score == pytest.approx(0) and out[1.0].valid_score == pytest.approx(10 * 40 / 60)
    by_hash = models.learning_curve(df.withColumn("fold", F.when(F.col("key") >= 60, 0).otherwise(-1)), model, "y", "key", [0.33], mae).first()
    assert by_hash.valid_score > 1


def test_neural_network_of_classes(spark):
    rng = np.random.default_rng(0)
    data = [(i, float(a), float(b), int(a * b > 0), i % 2) for i, (a, b) in enumerate(rng.normal(size=(240, 2)))]
    df = spark.createDataFrame(data, "key long, a double, b double, y int, fold int")
    pipeline = models.make_pipeline(models.model_factory("mlp", "binary", "y", layers=[2, 8, 2], seed=1, maxIter=200), ["a", "b"])
    out, _ = models.run_cv(df, pipeline, "binary", "key", "y")
    assert metrics.score_by(out.withColumn("g", F.lit(0)), "y", "pred", "accuracy", ["g"]).first()["score"] > 0.85


def test_limits_of_categories(spark, monkeypatch):
    from sparkseries.operators import categorical, joins

    monkeypatch.setattr(categorical, "MOST_CATEGORIES", 3)
    df = spark.createDataFrame([(i, f"c{i}") for i in range(4)], "i long, c string")
    for call in (lambda: categorical.OneHotEncoder(["c"]).fit(df), lambda: categorical.encode_target(df, "c")):
        with pytest.raises(ValueError, match="more than 3"):
            call()
    twice = spark.createDataFrame([("a", 2, "x"), ("a", 1, "z"), ("b", 5, "y"), (None, 1, "n")], "k string, n long, t string")
    got = joins.master_join(spark.createDataFrame([("a",), ("c",), (None,)], "key string"), twice, "key", "k").collect()
    assert sorted(map(tuple, got), key=str) == [("a", 1, "z"), ("c", None, None), (None, None, None)]


@pytest.mark.parametrize("metric", ["rmse", "r2"])
def test_trials_of_a_ridge_are_scored_together(spark, metric):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 2))
    data = [(i, float(a) if i % 7 else None, float(b), float(3 * a - b + rng.normal()), None if i % 50 == 3 else i % 4 - 1) for i, (a, b) in enumerate(x)]
    plain = spark.createDataFrame(data, "i long, a double, b double, y double, fold int").repartition(3)
    read = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(v):
        read.add(1)
        return v

    df = plain.withColumn("b", counted("b"))
    member = selection.ridge_member("r", ["a", "b"], target="y", key="i", metric=metric, space={"reg": ("float", 0.01, 100.0, "log")}, trials=6)
    best, rows = selection.searched(df, member)
    assert read.value == 300
    apart, want = selection.searched(plain, dataclasses.replace(member, several=None))
    assert best == apart and [(r["trial"], r["state"], r["rungs"]) for r in rows] == [(r["trial"], r["state"], r["rungs"]) for r in want]
    for r, w in zip(rows, want, strict=True):
        assert r["scores"] == pytest.approx(w["scores"], rel=1e-9)
