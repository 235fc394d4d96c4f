"""Out-of-fold linear models from second moments: one aggregate for all folds, and no fit that reads the rows again."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import is_finite
from .quantiles import quantiles
from .ranges import written

FOLD_SCHEMA = "_fold int, intercept double, coefficients array<double>, fills array<double>, means array<double>"


@dataclass(frozen=True)
class Ridge:
    """A linear model of features as they are; a missing value counts as its fill, and ``means`` are those of the training rows."""

    intercept: float
    coefficients: tuple[float, ...]
    fills: tuple[float, ...]
    means: tuple[float, ...]
    rows: int


def _solved(gram: np.ndarray, fills: np.ndarray, center: np.ndarray, scale: np.ndarray, reg: float) -> Ridge:
    """The model from the sums of products of 1, standardised features (0 where missing), marks of missing ones, and the standardised target."""
    p = len(fills)
    # 1, features with their fills, target, as combinations of what was summed
    a = np.zeros((p + 2, 2 * p + 2))
    a[0, 0] = a[p + 1, 2 * p + 1] = 1
    for i in range(p):
        a[i + 1, i + 1], a[i + 1, p + i + 1] = 1, (fills[i] - center[i]) / scale[i]
    g = a @ gram @ a.T / gram[0, 0]
    m = g[0, 1:]
    cov = g[1:, 1:] - np.outer(m, m)
    s = np.sqrt(np.maximum(np.diag(cov), 0))
    varies = np.flatnonzero(s[:p] > 1e-12 * np.maximum(1, np.abs(m[:p])))
    b = np.zeros(p)
    if len(varies) and s[p] > 0:
        corr = cov[np.ix_(varies, varies)] / np.outer(s[varies], s[varies])
        # the penalty is of standardised features, relative to the deviation of the target
        b[varies] = np.linalg.pinv(corr + reg / (s[p] * scale[p]) * np.eye(len(varies)), rcond=1e-11, hermitian=True) @ (cov[varies, p] / s[varies] / s[p]) * s[p] / s[varies]
    means = m[:p] * scale[:p] + center[:p]
    coefficients = b * scale[p] / scale[:p]
    return Ridge(float(m[p] * scale[p] + center[p] - coefficients @ means), tuple(coefficients.tolist()), tuple(fills.tolist()), tuple(means.tolist()), int(gram[0, 0]))


@dataclass(frozen=True)
class FoldSums:
    """What the ridges of all folds follow from, for any penalty."""

    training: dict[int, np.ndarray]
    fills: dict[int, np.ndarray]
    center: np.ndarray
    scale: np.ndarray

    def ridges(self, reg: float = 0.0) -> dict[int, Ridge]:
        return {k: _solved(g, self.fills[k], self.center, self.scale, reg) for k, g in self.training.items() if g[0, 0]}


def fold_ridges(df: DataFrame, features: Sequence[str], label: str, fold: str, reg: float = 0.0) -> dict[int, Ridge]:
    """For each fold from 0 the ridge of all other rows, those of fold -1 among them (``fold_sums``)."""
    return fold_sums(df, features, label, fold).ridges(reg)


def fold_sums(df: DataFrame, features: Sequence[str], label: str, fold: str) -> FoldSums:
    """The sums that the ridges of the folds from 0 are made from.

    A feature that is not finite counts as the median of the model's training rows; rows whose label is not finite, or without a fold, train no model; a fold without
    training rows has none. The penalty is that of ``pyspark.ml``'s LinearRegression with ``regParam=reg``. Sums of products of all columns by fold, a table of the number of
    folds, are one aggregate; a model's sums are those of the other folds. Medians are taken only of features with missing values.
    """
    p = len(features)
    rows = df.filter(is_finite(label) & F.col(fold).isNotNull())
    clean = [F.when(is_finite(c), F.col(c).cast("double")) for c in [*features, label]]
    first = rows.agg(*[f(x).alias(f"{n}{i}") for i, x in enumerate(clean) for n, f in (("m", F.avg), ("s", F.stddev_pop))], *[F.count_if(x.isNull()).alias(f"n{i}") for i, x in enumerate(clean)]).first()
    center = np.array([first[f"m{i}"] or 0.0 for i in range(p + 1)])
    scale = np.array([first[f"s{i}"] or 1.0 for i in range(p + 1)])
    standard = [F.coalesce((x - float(center[i])) / float(scale[i]), F.lit(0.0)) for i, x in enumerate(clean)]
    items = F.array(F.lit(1.0), *standard[:p], *[x.isNull().cast("double") for x in clean[:p]], standard[p])
    size = 2 * p + 2
    held = rows.select(F.col(fold).cast("int").alias("_fold"), items.alias("_x"))
    upper = [(i, j) for i in range(size) for j in range(i, size)]
    products = F.flatten(F.transform("_x", lambda x, i: F.transform(F.slice("_x", i + 1, size), lambda y: x * y)))
    sums = held.groupBy("_fold").agg(vector_to_array(Summarizer.sum(array_to_vector(products))).alias("_s")).collect()
    grams = {}
    for r in sums:
        g = np.zeros((size, size))
        for (i, j), v in zip(upper, r["_s"], strict=True):
            g[i, j] = g[j, i] = v
        grams[r["_fold"]] = g
    folds = sorted(k for k in grams if k >= 0)
    fills = {k: center[:p].copy() for k in folds}
    if missing := [i for i in range(p) if first[f"n{i}"]]:
        others = F.explode(F.array(*[F.lit(k) for k in folds])).alias("_of")
        values = rows.select(F.col(fold).cast("int").alias("_fold"), *[clean[i].alias(f"_{i}") for i in missing], others).filter(F.col("_fold") != F.col("_of"))
        for r in quantiles(values, {f"_{i}": F.col(f"_{i}") for i in missing}, [0.5], ["_of"]).collect():
            for i in missing:
                fills[r["_of"]][i] = r[f"_{i}"][0] if r[f"_{i}"] is not None else 0.0
    training = {k: sum((g for f, g in grams.items() if f != k), np.zeros((size, size))) for k in folds}
    return FoldSums(training, fills, center, scale)


def search_predictions(df: DataFrame, features: Sequence[str], label: str, fold: str) -> Callable[[Sequence[float], int], DataFrame]:
    """A function from penalties and a fold to ``trial, label, pred``: the rows of that fold predicted by the ridges of all other rows, for each penalty by its number.

    Sums are taken once; a fold is read once for all its penalties. Rows without a fold are in training only.
    """
    sums = fold_sums(df.withColumn(fold, F.coalesce(F.col(fold).cast("int"), F.lit(-1))), features, label, fold)

    def predicted(regs: Sequence[float], k: int) -> DataFrame:
        found = [sums.ridges(r).get(k) for r in regs]
        items = []
        for t, m in enumerate(found):
            pred = F.lit(m.intercept if m else None).cast("double")
            for c, b, v in zip(features, m.coefficients, m.fills, strict=True) if m else ():
                pred = pred + F.lit(b) * F.when(is_finite(c), F.col(c).cast("double")).otherwise(F.lit(v))
            items.append(F.struct(F.lit(t).alias("trial"), pred.alias("pred")))
        return df.filter(F.col(fold) == k).select(label, F.inline(F.array(*items)))

    return predicted


def _with_models(df: DataFrame, models: dict[int, Ridge], fold: str) -> DataFrame:
    table = df.sparkSession.createDataFrame([(k, m.intercept, list(m.coefficients), list(m.fills), list(m.means)) for k, m in models.items()], FOLD_SCHEMA)
    return df.join(F.broadcast(table), F.col(fold).cast("int") == F.col("_fold"), "left")


def _filled(c: str, i: int) -> Column:
    return F.when(is_finite(c), F.col(c).cast("double")).otherwise(F.get("fills", F.lit(i)))


def ridge_cv(df: DataFrame, features: Sequence[str], label: str, key: str, fold: str = "fold", reg: float = 0.0) -> tuple[DataFrame, dict[int, Ridge]]:
    """``key, fold, label, pred``: each row predicted by the ridge of the other folds (``fold_ridges``), and the models; rows of fold -1, without a fold or without a model have a null prediction.

    The input is written once and read three times, whatever the number of folds.
    """
    rows = written(df.select(*dict.fromkeys([key, fold, label, *features])))
    models = fold_ridges(rows, features, label, fold, reg)
    pred = F.col("intercept")
    for i, c in enumerate(features):
        pred = pred + F.get("coefficients", F.lit(i)) * _filled(c, i)
    return _with_models(rows, models, fold).select(*dict.fromkeys([key, fold, label]), pred.alias("pred")), models


def ridge_attributions(df: DataFrame, features: Sequence[str], label: str, fold: str, reg: float = 0.0, prefix: str = "attr_") -> DataFrame:
    """``df`` with each row explained by the ridge of the other folds: coefficient times (value - mean of that model's training rows)."""
    rows = written(df)
    joined = _with_models(rows, fold_ridges(rows, features, label, fold, reg), fold)
    added = [(F.get("coefficients", F.lit(i)) * (_filled(c, i) - F.get("means", F.lit(i)))).alias(f"{prefix}{c}") for i, c in enumerate(features)]
    return joined.select(*df.columns, *added)
