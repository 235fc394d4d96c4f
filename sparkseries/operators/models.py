"""Out-of-fold training with pyspark.ml, test prediction, search and curves."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from statistics import median

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import ratio
from .base import Learned, Learner
from .folds import most_recent
from .numeric import StandardImputer
from .ranges import written
from .reshape import ModelInput


class Dummy(Learner):
    """The mean of the target, or the shares of its classes, for every row."""

    def __init__(self, label: str, classes: int = 0):
        super().__init__([])
        self.label, self.classes = label, classes

    def _fit(self, dataset: DataFrame) -> DummyModel:
        y = F.col(self.label)
        row = dataset.agg(*([F.avg((y == k).cast("double")) for k in range(self.classes)] if self.classes else [F.avg(y)])).first()
        return DummyModel([v if v is not None else 0.0 for v in row], bool(self.classes))


class DummyModel(Learned):
    def __init__(self, values: list[float], shares: bool):
        super().__init__([])
        self.values, self.shares = values, shares

    def _transform(self, dataset: DataFrame) -> DataFrame:
        if self.shares:
            return dataset.withColumn("probability", F.array(*[F.lit(float(v)) for v in self.values]))
        return dataset.withColumn("prediction", F.lit(float(self.values[0])))


def model_factory(kind: str, task: str, label: str, classes: int = 2, **options) -> Estimator:
    """dummy, linear (ridge or logistic), gbt, mlp (classes only; give ``layers``)."""
    regression = task in ("regression", "time_series")
    common = {"featuresCol": "features", "labelCol": label}
    if kind == "dummy":
        return Dummy(label, 0 if regression else classes)
    if kind == "linear":
        return LinearRegression(**common, elasticNetParam=0.0, **options) if regression else LogisticRegression(**common, **options)
    if kind == "gbt":
        if regression:
            return GBTRegressor(**common, **options)
        one = GBTClassifier(**common, **options)
        return one if classes == 2 else OneVsRest(classifier=one, featuresCol="features", labelCol=label)
    if kind == "mlp" and not regression:
        return MultilayerPerceptronClassifier(**common, **options)
    raise ValueError(f"no model {kind} for {task}")


def make_pipeline(model: Estimator, features: Sequence[str], steps: Sequence = (), standardize: bool = True) -> Pipeline:
    """Preprocessing and model as one stage, so that both are fitted on training rows only."""
    return Pipeline(stages=[*steps, *([StandardImputer(list(features))] if standardize else []), ModelInput(list(features)), model])


def predictions(model: PipelineModel, rows: DataFrame, task: str, keep: Sequence[str], classes: int = 2, seen: Sequence[int] | None = None) -> DataFrame:
    """``keep`` and ``pred`` (value, or probability of label 1; 0 if the fold never saw it) or ``pred_0..`` (one per class, missing ones 0, summing to 1)."""
    out = model.transform(rows)
    if task in ("regression", "time_series"):
        return out.select(*keep, F.col("prediction").cast("double").alias("pred"))
    if "probability" in out.columns:
        p = F.col("probability") if dict(out.dtypes)["probability"].startswith("array") else vector_to_array("probability")
        of = lambda k: F.coalesce(F.get(p, F.lit(k)), F.lit(0.0)) if seen is None or k in seen else F.lit(0.0)
    else:
        of = lambda k: (F.col("prediction") == k).cast("double")
    if task == "binary":
        return out.select(*keep, of(1).alias("pred"))
    total = reduce(lambda a, b: a + b, [of(k) for k in range(classes)])
    return out.select(*keep, *[F.coalesce(ratio(of(k), total), F.lit(0.0)).alias(f"pred_{k}") for k in range(classes)])


def fit_early(pipeline: Pipeline, train: DataFrame, held: DataFrame) -> PipelineModel:
    """``pipeline`` fitted on ``train``; its boosted trees stop when the loss on ``held`` falls no further.

    Preprocessing sees training rows only. The model keeps the trees up to its best iteration.
    """
    *steps, last = pipeline.getStages()
    if not last.hasParam("validationIndicatorCol"):
        raise ValueError("only boosted trees of one score stop early")
    before = Pipeline(stages=steps).fit(train)
    rows = before.transform(train).withColumn("_held", F.lit(False)).unionByName(before.transform(held).withColumn("_held", F.lit(True)))
    # the trees read them several times over
    rows = written(rows.select(last.getFeaturesCol(), last.getLabelCol(), "_held"))
    return PipelineModel([*before.stages, last.copy({last.getParam("validationIndicatorCol"): "_held"}).fit(rows)])


def best_iteration(fitted: Mapping[int, PipelineModel]) -> int:
    """The mean number of trees that the folds' models kept, rounded, at least 1."""
    return max(1, round(sum(len(m.stages[-1].treeWeights) for m in fitted.values()) / len(fitted)))


def refit(df: DataFrame, pipeline: Pipeline, fitted: Mapping[int, PipelineModel]) -> PipelineModel:
    """The pipeline fitted on all rows with the folds' mean best iteration, for ``predict_test``."""
    *steps, last = pipeline.getStages()
    return Pipeline(stages=[*steps, last.copy({last.getParam("maxIter"): best_iteration(fitted)})]).fit(df)


def run_cv(df: DataFrame, pipeline: Estimator, task: str, key: str, label: str, fold: str = "fold", classes: int = 2, callback: Callable[[int, PipelineModel], None] | None = None, early: bool = False) -> tuple[DataFrame, dict[int, PipelineModel]]:
    """Out-of-fold predictions and the folds' models.

    For each fold, preprocessing and model are fitted on the other rows and predict the fold's own. Rows of fold -1 are in
    training only, and have null predictions. The driver loops over folds; fitting and scoring are Spark jobs, which read the table as it is written
    once. ``early`` stops boosted trees by the fold's own rows (``fit_early``).
    """
    df = written(df)
    folds = sorted(r[0] for r in df.select(fold).distinct().collect() if r[0] is not None and r[0] >= 0)
    parts, fitted = [], {}
    for k in folds:
        train = df.filter(F.col(fold) != k)
        seen = None if task in ("regression", "time_series") else [r[0] for r in train.select(label).distinct().collect()]
        fitted[k] = fit_early(pipeline, train, df.filter(F.col(fold) == k)) if early else pipeline.fit(train)
        if callback:
            callback(k, fitted[k])
        parts.append(predictions(fitted[k], df.filter(F.col(fold) == k), task, [key, fold, label], classes, seen))
    out = reduce(DataFrame.unionByName, parts)
    rest = df.filter(F.col(fold) < 0).select(key, fold, label)
    return out.unionByName(rest, allowMissingColumns=True), fitted


def predict_test(test: DataFrame, task: str, key: str, models: Mapping[int, PipelineModel] | None = None, refit: PipelineModel | None = None, classes: int = 2) -> DataFrame:
    """The mean of the fold models' predictions, or those of one model fitted on all rows."""
    if refit is not None:
        return predictions(refit, test, task, [key], classes)
    every = reduce(DataFrame.unionByName, [predictions(m, test, task, [key], classes) for m in models.values()])
    return every.groupBy(key).agg(*[F.avg(c).alias(c) for c in every.columns if c != key])


def linear_attributions(df: DataFrame, coefficients: Mapping[str, float], means: Mapping[str, float], prefix: str = "attr_") -> DataFrame:
    """Exact attributions of a linear model: coefficient times (value - background mean)."""
    return df.withColumns({f"{prefix}{c}": F.lit(float(b)) * (F.col(c) - F.lit(float(means[c]))) for c, b in coefficients.items()})


def learning_curve(df: DataFrame, pipeline: Estimator, label: str, key: str, shares: Sequence[float], score: Callable[[DataFrame], float], fold: str = "fold", time: str | Sequence[str] | None = None) -> DataFrame:
    """``share, train_score, train_std, valid_score, valid_std``: fits on a share of each fold's training rows, the most recent ones if ``time`` is given, else chosen by hash of the key."""
    rows = []
    folds = sorted(r[0] for r in df.select(fold).distinct().collect() if r[0] >= 0)
    for share in shares:
        scores = []
        for k in folds:
            others = df.filter(F.col(fold) != k)
            train = most_recent(others, time, share) if time else others.filter(F.pmod(F.xxhash64(key), F.lit(10_000)) < int(share * 10_000))
            model = pipeline.fit(train)
            scores.append((score(model.transform(train)), score(model.transform(df.filter(F.col(fold) == k)))))
        rows.append((float(share), *_mean_std([s[0] for s in scores]), *_mean_std([s[1] for s in scores])))
    return df.sparkSession.createDataFrame(rows, "share double, train_score double, train_std double, valid_score double, valid_std double")


def validation_curve(df: DataFrame, make: Callable[[float], Estimator], values: Sequence[float], score: Callable[[DataFrame], float], fold: str = "fold") -> DataFrame:
    """The same over values of a parameter."""
    rows = []
    folds = sorted(r[0] for r in df.select(fold).distinct().collect() if r[0] >= 0)
    for value in values:
        scores = []
        for k in folds:
            train = df.filter(F.col(fold) != k)
            model = make(value).fit(train)
            scores.append((score(model.transform(train)), score(model.transform(df.filter(F.col(fold) == k)))))
        rows.append((float(value), *_mean_std([s[0] for s in scores]), *_mean_std([s[1] for s in scores])))
    return df.sparkSession.createDataFrame(rows, "value double, train_score double, train_std double, valid_score double, valid_std double")


def _mean_std(xs: Sequence[float]) -> tuple[float, float]:
    m = sum(xs) / len(xs)
    return m, math.sqrt(sum((x - m) ** 2 for x in xs) / len(xs))


def training_history(model, rows: DataFrame | None = None, loss: str = "squared") -> list[float]:
    """The loss after each iteration: of a linear model as it was trained, of boosted trees on ``rows`` (``loss`` for regression)."""
    if isinstance(model, GBTRegressionModel):
        return list(model.evaluateEachIteration(rows, loss))
    if isinstance(model, GBTClassificationModel):
        return list(model.evaluateEachIteration(rows))
    if hasattr(model, "summary"):
        return list(model.summary.objectiveHistory)
    raise TypeError("this model keeps no history")


def sample_space(space: Mapping[str, tuple], seed: int, trial: int) -> dict:
    """One point: ("float", low, high[, "log"]), ("int", low, high[, step]), ("categorical", [..]) or ("fixed", value)."""
    draw, out = random.Random(f"{seed}:{trial}"), {}
    for name, (kind, *args) in sorted(space.items()):
        if kind == "float":
            low, high = args[:2]
            out[name] = math.exp(draw.uniform(math.log(low), math.log(high))) if "log" in args[2:] else draw.uniform(low, high)
        elif kind == "int":
            out[name] = draw.randrange(args[0], args[1] + 1, args[2] if len(args) > 2 else 1)
        elif kind == "categorical":
            out[name] = draw.choice(args[0])
        elif kind == "fixed":
            out[name] = args[0]
        else:
            raise ValueError(f"no kind {kind}")
    return out


def tune(objective: Callable[[dict], float], space: Mapping[str, tuple], trials: int, greater: bool = False, seed: int = 0, threads: int = 4, spark=None):
    """Seeded random search: the best parameters, and the trials as (trial, parameters, score) rows, best first. Trials run side by side."""
    points = [sample_space(space, seed, k) for k in range(trials)]
    with ThreadPoolExecutor(threads) as pool:
        scores = list(pool.map(objective, points))
    order = sorted(range(trials), key=lambda k: (-scores[k] if greater else scores[k], k))
    rows = [(k, {n: str(v) for n, v in points[k].items()}, float(scores[k])) for k in order]
    return points[order[0]], rows if spark is None else spark.createDataFrame(rows, "trial int, parameters map<string,string>, score double")


def tune_by_folds(objective: Callable, space: Mapping[str, tuple], trials: int, folds: Sequence[int], greater: bool = False, seed: int = 0, threads: int = 4, startup: int = 4, warmup: int = 1, together: bool = False) -> tuple[dict, list[dict]]:
    """Seeded random search that stops bad trials early: the best parameters, and a row for each trial, complete and best first.

    ``objective(params, fold)`` is the score of one fold; with ``together`` it is given a list of parameters and gives a list of scores. The folds are rungs: after each, a trial whose mean so far is worse than the median of the others' is stopped and fitted no further, if at
    least ``startup`` trials are left and ``warmup`` rungs are done. Trials of a rung run side by side; what is stopped depends on scores only, so one seed gives one table.
    Rows: trial, params, state (complete or stopped), rungs, score (the mean of the folds done), scores.
    """
    points = [sample_space(space, seed, k) for k in range(trials)]
    scores: dict[int, list[float]] = {k: [] for k in range(trials)}
    alive, sign = list(range(trials)), -1.0 if greater else 1.0
    mean = lambda k: sum(scores[k]) / len(scores[k])
    with ThreadPoolExecutor(threads) as pool:
        for rung, fold in enumerate(folds):
            found = objective([points[k] for k in alive], fold) if together else pool.map(lambda k, f=fold: objective(points[k], f), alive)
            for k, v in zip(alive, found, strict=True):
                scores[k].append(float(v))
            if rung + 1 >= len(folds) or rung + 1 < warmup or len(alive) < startup:
                continue
            # worse than the middle of the others at this rung
            alive = [k for k in alive if sign * mean(k) <= median([sign * mean(j) for j in alive if j != k])]
    whole = set(alive)
    order = sorted(range(trials), key=lambda k: (k not in whole, sign * mean(k), k))
    rows = [{"trial": k, "params": points[k], "state": "complete" if k in whole else "stopped", "rungs": len(scores[k]), "score": mean(k), "scores": scores[k]} for k in order]
    return points[order[0]], rows


def trials_table(spark, rows: Sequence[Mapping]) -> DataFrame:
    """The rows of ``tune_by_folds``: ``trial, params, state, rungs, score, scores``."""
    return spark.createDataFrame([(r["trial"], {n: str(v) for n, v in r["params"].items()}, r["state"], r["rungs"], r["score"], r["scores"]) for r in rows], "trial int, params map<string,string>, state string, rungs int, score double, scores array<double>")


def leaderboard(scores: DataFrame, score: str = "score", greater: bool = False) -> DataFrame:
    """Scores with ``rank``: equal scores share the better rank."""
    from pyspark.sql import Window

    order = F.desc_nulls_last(score) if greater else F.asc_nulls_last(score)
    return scores.withColumn("rank", F.rank().over(Window.orderBy(order)).cast("long"))
