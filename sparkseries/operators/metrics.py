"""Metrics as aggregates over a table of predictions; every one can be taken by fold, series or step."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import col, is_finite, ratio
from .ranges import RANGE_ROWS, along

EPS = 2.220446049250313e-16


def mse(y, p) -> Column:
    return F.avg(F.pow(col(y) - col(p), F.lit(2.0)))


def rmse(y, p) -> Column:
    return F.sqrt(mse(y, p))


def mae(y, p) -> Column:
    return F.avg(F.abs(col(y) - col(p)))


def mape(y, p) -> Column:
    """A ratio; the denominator is at least EPS."""
    return F.avg(F.abs(col(y) - col(p)) / F.greatest(F.abs(col(y)), F.lit(EPS)))


def rmsle(y, p) -> Column:
    """A negative target is an error; a negative prediction counts as 0."""
    target = F.when(col(y) < 0, F.raise_error(F.lit("a target of rmsle is negative")).cast("double")).otherwise(F.log1p(col(y)))
    return F.sqrt(F.avg(F.pow(target - F.log1p(F.greatest(col(p), F.lit(0.0))), F.lit(2.0))))


def r2(y, p) -> Column:
    """Null for fewer than two rows or a constant target."""
    return F.when(F.count(col(y)) >= 2, 1 - ratio(F.sum(F.pow(col(y) - col(p), F.lit(2.0))), F.nullif(F.var_pop(col(y)) * F.count(col(y)), F.lit(0.0))))


def logloss(y, p, eps: float = EPS) -> Column:
    """Binary: ``p`` is the probability of label 1."""
    q = F.least(F.greatest(col(p), F.lit(eps)), F.lit(1 - eps))
    return F.avg(-F.when(col(y) == 1, F.ln(q)).otherwise(F.ln(1 - q)))


def multiclass_logloss(y, ps: Sequence[str], eps: float = EPS) -> Column:
    """``ps`` are the classes' probabilities, normalised by row."""
    total = sum((F.col(c) for c in ps[1:]), F.col(ps[0]))
    own = F.element_at(F.array(*[F.col(c) for c in ps]), col(y).cast("int") + 1)
    return F.avg(-F.ln(F.least(F.greatest(own / total, F.lit(eps)), F.lit(1 - eps))))


def binary_label(p, threshold: float = 0.5) -> Column:
    return (col(p) >= threshold).cast("int")


def argmax_label(ps: Sequence[str]) -> Column:
    """The class of the greatest probability, the first of equals."""
    values = F.array(*[F.col(c) for c in ps])
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def confusion(df: DataFrame, y: str, label: str, classes: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """``by, actual, predicted, n, share``: every pair of classes, also those that do not occur; the share is of the actual class."""
    spark = df.sparkSession
    pairs = spark.createDataFrame([(a, b) for a in classes for b in classes], "actual int, predicted int")
    counts = df.groupBy(*by, F.col(y).cast("int").alias("actual"), F.col(label).cast("int").alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    every = pairs if not by else df.select(*by).distinct().crossJoin(F.broadcast(pairs))
    out = every.join(counts, [*by, "actual", "predicted"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy(*by, "actual"))
    return out.withColumn("share", F.coalesce(ratio("n", total), F.lit(0.0)))


def class_scores(matrix: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by, class, tp, fp, fn, precision, recall, f1`` from a confusion table; a zero denominator gives 0."""
    rows = matrix.select(*by, F.explode(F.array(F.struct(F.col("actual").alias("class"), F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("long").alias("fp"), F.when(F.col("actual") != F.col("predicted"), F.col("n")).otherwise(0).alias("fn")), F.struct(F.col("predicted").alias("class"), F.lit(0).cast("long").alias("tp"), F.when(F.col("actual") != F.col("predicted"), F.col("n")).otherwise(0).alias("fp"), F.lit(0).cast("long").alias("fn")))).alias("x")).select(*by, "x.*")
    sums = rows.groupBy(*by, "class").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    zero = lambda a, b: F.coalesce(ratio(a, b), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sums.withColumn("precision", zero(tp, tp + fp)).withColumn("recall", zero(tp, tp + fn)).withColumn("f1", zero(2 * tp, 2 * tp + fp + fn))


def averaged_scores(matrix: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by, average, precision, recall, f1`` for micro, macro and weighted averages over all classes."""
    scores = class_scores(matrix, by).withColumn("support", F.col("tp") + F.col("fn"))
    zero = lambda a, b: F.coalesce(ratio(a, b), F.lit(0.0))
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    parts = {
        "micro": (zero(tp, tp + fp), zero(tp, tp + fn), zero(2 * tp, 2 * tp + fp + fn)),
        "macro": tuple(F.avg(c) for c in ("precision", "recall", "f1")),
        "weighted": tuple(zero(F.sum(F.col(c) * F.col("support")), F.sum("support")) for c in ("precision", "recall", "f1")),
    }
    items = [F.struct(F.lit(k).alias("average"), *[v.alias(n) for v, n in zip(vs, ("precision", "recall", "f1"), strict=True)]) for k, vs in parts.items()]
    grouped = scores.groupBy(*by) if by else scores.groupBy()
    return grouped.agg(F.array(*items).alias("x")).select(*by, F.explode("x").alias("x")).select(*by, "x.*")


def agreement_scores(matrix: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by, accuracy, mcc, g_mean``: a class that is never found, or absent, makes the geometric mean of recalls 0."""
    scores = class_scores(matrix, by)
    total = matrix.groupBy(*by).agg(F.sum("n").alias("s"), F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)).alias("c")) if by else matrix.agg(F.sum("n").alias("s"), F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)).alias("c"))
    t, p = (F.col("tp") + F.col("fn")).cast("double"), (F.col("tp") + F.col("fp")).cast("double")
    recall = F.col("recall")
    grouped = scores.groupBy(*by) if by else scores.groupBy()
    sums = grouped.agg(F.sum(t * p).alias("tp_"), F.sum(t * t).alias("tt"), F.sum(p * p).alias("pp"), F.when(F.min(recall) > 0, F.exp(F.avg(F.ln(F.when(recall > 0, recall))))).otherwise(0.0).alias("g_mean"))
    both = total.join(sums, list(by)) if by else total.crossJoin(sums)
    s, c = F.col("s").cast("double"), F.col("c").cast("double")
    below = F.sqrt((s * s - F.col("pp")) * (s * s - F.col("tt")))
    return both.select(*by, ratio(c, s).alias("accuracy"), F.coalesce(ratio(c * s - F.col("tp_"), below), F.lit(0.0)).alias("mcc"), "g_mean")


def _score_counts(df: DataFrame, y: str, score: str, by: Sequence[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """Positives and negatives at each distinct score, with running sums from the highest, by ranges of scores; what follows works on distinct scores only."""
    at = df.groupBy(*by, F.col(score).cast("double").alias("score")).agg(F.sum((F.col(y) == 1).cast("long")).alias("p"), F.sum((F.col(y) != 1).cast("long")).alias("q"))
    p, q = F.col("p"), F.col("q")
    return along(at, by, ["score"], sums={"tp": p, "fp": q}, totals={"pos": p, "neg": q}, descending=True, range_rows=range_rows, rows=df.count())


def roc_points(df: DataFrame, y: str, score: str, by: Sequence[str] = (), range_rows: int = RANGE_ROWS) -> DataFrame:
    """``by, score, fpr, tpr`` at each distinct score and the origin (null score)."""
    rows = _score_counts(df, y, score, by, range_rows)
    points = rows.select(*by, "score", ratio("fp", "neg").alias("fpr"), ratio("tp", "pos").alias("tpr"))
    origin = (df.select(*by).distinct() if by else df.limit(1)).select(*by, F.lit(None).cast("double").alias("score"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return points.unionByName(origin)


def pr_points(df: DataFrame, y: str, score: str, by: Sequence[str] = (), range_rows: int = RANGE_ROWS) -> DataFrame:
    """``by, score, precision, recall, chance`` at each distinct score."""
    rows = _score_counts(df, y, score, by, range_rows)
    return rows.select(*by, "score", ratio("tp", F.col("tp") + F.col("fp")).alias("precision"), ratio("tp", "pos").alias("recall"), ratio("pos", F.col("pos") + F.col("neg")).alias("chance"))


def ranking_scores(df: DataFrame, y: str, score: str, by: Sequence[str] = (), max_fpr: float = 0.1, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``by, n_pos, n_neg, roc_auc, average_precision, pauc``: equal scores share a point; ``pauc`` is the area up to ``max_fpr`` as McClish scales it. Null where a class is absent."""
    if not 0 < max_fpr <= 1:
        raise ValueError("the rate must be in (0, 1]")
    rows = _score_counts(df, y, score, by, range_rows)
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    # twice the pairs ordered right: each positive beats the negatives below it and half of those beside it
    beaten = F.sum(F.col("p") * (2 * (F.col("neg") - F.col("fp")) + F.col("q")))
    x1, x0 = ratio("fp", neg), ratio(F.col("fp") - F.col("q"), neg)
    y1, y0 = ratio("tp", pos), ratio(F.col("tp") - F.col("p"), pos)
    end = F.least(x1, F.lit(float(max_fpr)))
    cut = y0 + F.coalesce(ratio(y1 - y0, x1 - x0), F.lit(0.0)) * (end - x0)
    area = F.sum(F.when(end > x0, (end - x0) * (y0 + cut) / 2).otherwise(0.0))
    grouped = rows.groupBy(*by, "pos", "neg")
    out = grouped.agg(beaten.alias("b"), F.sum(ratio("p", pos) * ratio("tp", F.col("tp") + F.col("fp"))).alias("ap"), area.alias("a"))
    low = 0.5 * max_fpr * max_fpr
    both = (F.col("pos") > 0) & (F.col("neg") > 0)
    scaled = F.col("a") if max_fpr == 1 else 0.5 * (1 + (F.col("a") - low) / (max_fpr - low))
    return out.select(*by, F.col("pos").alias("n_pos"), F.col("neg").alias("n_neg"), F.when(both, F.col("b") / (2.0 * pos * neg)).alias("roc_auc"), F.when(F.col("pos") > 0, F.col("ap")).alias("average_precision"), F.when(both, scaled).alias("pauc"))


def one_vs_rest(df: DataFrame, y: str, ps: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """A row per row and class: ``class, hit, score``."""
    items = F.array(*[F.struct(F.lit(k).alias("class"), (F.col(y) == k).cast("int").alias("hit"), F.col(c).alias("score")) for k, c in enumerate(ps)])
    return df.select(*keep, F.explode(items).alias("x")).select(*keep, "x.*")


def multiclass_auc(df: DataFrame, y: str, ps: Sequence[str], average: str = "macro") -> DataFrame:
    """One row ``roc_auc``: the mean over classes that occur and do not always occur, or over all (row, class) pairs as one ranking for ``micro``."""
    long = one_vs_rest(df, y, ps)
    if average == "micro":
        return ranking_scores(long, "hit", "score").select("roc_auc")
    return ranking_scores(long, "hit", "score", ["class"]).agg(F.avg("roc_auc").alias("roc_auc"))


@dataclass(frozen=True)
class Metric:
    """A metric as an aggregate over (target, prediction), which way is better, and the tasks it is for."""

    name: str
    of: Callable[..., Column] | None
    greater: bool
    tasks: tuple[str, ...]

    @property
    def direction(self) -> str:
        return "max" if self.greater else "min"


_REGRESSION, _CLASSES = ("regression", "time_series"), ("binary", "multiclass")
METRICS = {m.name: m for m in [*(Metric(f.__name__, f, False, _REGRESSION) for f in (rmse, mse, mae, mape, rmsle)), Metric("r2", r2, True, _REGRESSION), Metric("logloss", logloss, False, _CLASSES), *(Metric(n, None, True, _CLASSES) for n in ("accuracy", "mcc", "g_mean", "roc_auc", *(f"{s}_{a}" for s in ("precision", "recall", "f1") for a in ("micro", "macro", "weighted")), "roc_auc_micro", "roc_auc_macro")), *(Metric(n, None, True, ("binary",)) for n in ("precision", "recall", "f1", "pr_auc", "pauc"))]}
METRICS["auc"] = METRICS["roc_auc"]


def get_metric(name: str, task: str | None = None) -> tuple[Metric, dict[str, float]]:
    """A metric by its name and its parameters: ``pauc@0.2`` is the partial area up to 0.2."""
    base, _, rate = name.partition("@")
    if base not in METRICS or (rate and base != "pauc"):
        raise ValueError(f"no metric {name}")
    options: dict[str, float] = {}
    if rate:
        if not re.fullmatch(r"\d*\.?\d+", rate) or not 0 < float(rate) <= 1:
            raise ValueError(f"the rate of {name} must be in (0, 1]")
        options["max_fpr"] = float(rate)
    metric = METRICS[base]
    if task is not None and task not in metric.tasks:
        raise ValueError(f"{name} is not for {task}")
    return metric, options


def score_by(df: DataFrame, y: str, p: str, metric: str, by: Sequence[str]) -> DataFrame:
    """``by, score``: any metric of one column of predictions (values, or probabilities of label 1) for each group; all groups in one pass."""
    found, options = get_metric(metric)
    if found.of is not None:
        return df.groupBy(*by).agg(found.of(y, p).alias("score"))
    if found.name in ("roc_auc", "roc_auc_micro", "roc_auc_macro", "pr_auc", "pauc"):
        column = {"pr_auc": "average_precision", "pauc": "pauc"}.get(found.name, "roc_auc")
        return ranking_scores(df, y, p, by, **options).select(*by, F.col(column).alias("score"))
    matrix = confusion(df.withColumn("_label", binary_label(p)), y, "_label", [0, 1], by)
    if found.name in ("accuracy", "mcc", "g_mean"):
        return agreement_scores(matrix, by).select(*by, F.col(found.name).alias("score"))
    name, _, average = found.name.partition("_")
    if not average:
        return class_scores(matrix, by).filter("class = 1").select(*by, F.col(name).alias("score"))
    return averaged_scores(matrix, by).filter(F.col("average") == average).select(*by, F.col(name).alias("score"))


def regression_scores(df: DataFrame, y: str, p: str, by: Sequence[str] = (), rollup: bool = False) -> DataFrame:
    """``by, n, rmse, mse, mae, mape, r2`` over finite pairs; with ``rollup`` also over all (nulls in ``by``)."""
    rows = df.filter(is_finite(y) & is_finite(p))
    grouped = rows.rollup(*by) if rollup else rows.groupBy(*by)
    return grouped.agg(F.count(F.lit(1)).alias("n"), rmse(y, p).alias("rmse"), mse(y, p).alias("mse"), mae(y, p).alias("mae"), mape(y, p).alias("mape"), r2(y, p).alias("r2"))


def fold_summary(df: DataFrame, y: str, p: str, fold: str, metric: Callable[..., Column] = rmse) -> DataFrame:
    """One row: the mean and population deviation of the folds' scores, and the score of all rows together; fold -1 is left out."""
    rows = df.filter(F.col(fold) >= 0)
    folds = rows.groupBy(fold).agg(metric(y, p).alias("score")).agg(F.avg("score").alias("fold_mean"), F.stddev_pop("score").alias("fold_std"), F.count(F.lit(1)).alias("n_folds"))
    return folds.crossJoin(rows.agg(metric(y, p).alias("oof_score")))


def horizon_scores(df: DataFrame, y: str, p: str, step: str, metric: Callable[..., Column] = mae) -> DataFrame:
    """``step, n, score``: null where there is nothing to compute."""
    ok = is_finite(y) & is_finite(p)
    a, b = F.when(ok, F.col(y)), F.when(ok, F.col(p))
    return df.groupBy(F.col(step).cast("long").alias("step")).agg(F.count(a).alias("n"), metric(a, b).alias("score"))


def valid_mae(df: DataFrame, variable: str, y: str, p: str, valid: Column) -> DataFrame:
    """``variable, n, mae`` by variable and over all (null), rows that do not count left out."""
    ok = F.coalesce(valid, F.lit(False))
    return df.rollup(variable).agg(F.count_if(ok).alias("n"), F.avg(F.when(ok, F.abs(F.col(y) - F.col(p)))).alias("mae"))
