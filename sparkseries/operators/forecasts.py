"""Recursive forecasts: predictions become the history of the next step; future targets are never read."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import clip, is_finite
from .base import as_list, ordered
from .joins import overlapping_series
from .ranges import written
from .windows import TargetHistory, step_index, tail


@dataclass
class LinearHistoryModel:
    """Coefficients over features of a target's past, small enough to travel with every task."""

    lags: Sequence[int]
    windows: Sequence[int]
    roc: bool
    coefficients: Sequence[float]
    intercept: float
    difference: int = 0
    log_offset: float | None = None

    @property
    def lookback(self) -> int:
        return max([*self.lags, *self.windows, 2 if self.roc else 1]) + self.difference

    def predict(self, past: Sequence[float]) -> float:
        """The next value of the series that the model was trained on, from its past; NaN if a feature is undefined."""
        x = [past[-k] for k in self.lags] + [sum(past[-w:]) / w for w in self.windows]
        if self.roc:
            x.append((past[-1] - past[-2]) / past[-2] if past[-2] else float("nan"))
        return self.intercept + sum(a * b for a, b in zip(self.coefficients, x, strict=True))

    def forecast(self, history: Sequence[float], steps: int, low: float | None = None, high: float | None = None) -> list[float]:
        """The next ``steps`` values, each limited to ``low`` and ``high`` before it becomes the past of the next; with ``difference`` p the model's series is y_t - y_{t-p} and values are added back on.

        With ``log_offset`` c the series is log(y + c) before any difference; a past value with no logarithm makes what rests on it NaN.
        On the scale of a difference or a logarithm limits mean nothing: then only what is returned is limited, and the past goes on without.
        """
        y, p, c = [float(v) for v in history], self.difference, self.log_offset
        if c is not None:
            y = [math.log(v + c) if v + c > 0 else math.nan for v in y]
        z = [b - a for a, b in zip(y, y[p:], strict=False)] if p else y
        out: list[float] = []

        def limited(v: float) -> float:
            v = low if low is not None and v < low else v
            return high if high is not None and v > high else v

        for _ in range(steps):
            if len(z) < self.lookback - p:
                return out + [float("nan")] * (steps - len(out))
            step = self.predict(z)
            value = step + y[-p] if p else step if c is not None else limited(step)
            if p:
                z.append(step)
            y.append(value)
            out.append(limited(value if c is None else _exp(value) - c))
        return out


def _exp(v: float) -> float:
    """As Spark's ``exp``: too large a power is infinite, not an error."""
    try:
        return math.exp(v)
    except OverflowError:
        return math.inf


def _log_target(df: DataFrame, target: str, log_offset: float | None) -> DataFrame:
    return df if log_offset is None else df.withColumn(target, F.log(F.col(target) + F.lit(float(log_offset))))


def fit_linear_history(df: DataFrame, target: str, time: str, series, lags: Sequence[int] = (1,), windows: Sequence[int] = (), roc: bool = False, difference: int = 0, reg: float = 0.0, log_offset: float | None = None) -> LinearHistoryModel:
    """One linear model for all series on features of the past of the target, or of its difference over ``difference`` rows.

    With ``log_offset`` c it is fitted to log(target + c); a target without a logarithm is an error. Nulls are left out.
    """
    if log_offset is not None:
        bad = df.filter(F.col(target) + F.lit(float(log_offset)) <= 0).count()
        if bad:
            raise ValueError(f"{bad} values of {target} plus {log_offset} have no logarithm")
    rows = _log_target(df, target, log_offset)
    if difference:
        rows = rows.withColumn(target, F.col(target) - F.lag(target, difference).over(ordered(time, series)))
        rows = rows.filter(F.col(target).isNotNull())
    history = TargetHistory(target, time, series, lags, windows, roc)
    rows = history.transform(rows)
    ok = is_finite(target)
    for c in history.names:
        ok = ok & is_finite(c)
    vectors = VectorAssembler(inputCols=history.names, outputCol="features").transform(rows.filter(ok))
    model = LinearRegression(featuresCol="features", labelCol=target, regParam=reg).fit(vectors)
    return LinearHistoryModel(tuple(lags), tuple(windows), roc, model.coefficients.toArray().tolist(), float(model.intercept), difference, log_offset)


def recursive_forecast(model: LinearHistoryModel, history: DataFrame, future: DataFrame, target: str, time: str, series, low: float | None = None, high: float | None = None) -> DataFrame:
    """``series, time, step, pred`` for every future row, one task group per series and no driver loop over steps.

    Of the history, only the last ``lookback`` rows of each series travel. The future's target column, if any, is not read. A
    series whose future does not begin after its history is an error. Each step is clipped to ``low`` and ``high`` before it becomes the history of the next; a model of
    differences or logarithms is clipped on the original scale only, after the recursion.
    """
    keys = as_list(series)
    if not overlapping_series(history, future, time, keys).isEmpty():
        raise ValueError("a future begins before its history ends")
    back = Window.partitionBy(*keys).orderBy(F.desc(time))
    past = history.filter(F.col(target).isNotNull()).withColumn("_rn", F.row_number().over(back)).filter(F.col("_rn") <= model.lookback)
    past = past.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(time, F.col(target).cast("double").alias("v")))), lambda x: x["v"]).alias("_past"))
    ahead = step_index(future.select(*keys, time), time, keys)
    steps = ahead.groupBy(*keys).agg(F.max("step").alias("_steps")).join(past, keys, "left")

    def run(batches):
        for batch in batches:
            out = [model.forecast(p if p is not None else [], int(n), low, high) for p, n in zip(batch["_past"], batch["_steps"], strict=True)]
            yield batch[keys].assign(_preds=out)

    schema = T.StructType([*(steps.schema[k] for k in keys), T.StructField("_preds", T.ArrayType(T.DoubleType()))])
    found = steps.mapInPandas(run, schema)
    pred = F.nanvl(F.get("_preds", (F.col("step") - 1).cast("int")), F.lit(None).cast("double"))
    return ahead.join(found, keys).select(*keys, time, "step", pred.alias("pred"))


def one_step(model: LinearHistoryModel, df: DataFrame, target: str, time: str, series) -> DataFrame:
    """``df`` with ``pred_one_step``: each row predicted from the true past, as an expression."""
    p, c = model.difference, model.log_offset
    y = F.col(target) if c is None else F.log(F.col(target) + F.lit(float(c)))
    rows, z, base = df.withColumn("_y", y), "_y", F.lag("_y", p or 1).over(ordered(time, series))
    if p:
        rows, z = rows.withColumn("_z", F.col("_y") - base), "_z"
    history = TargetHistory(z, time, series, model.lags, model.windows, model.roc)
    rows = history.transform(rows)
    pred = F.lit(model.intercept)
    for name, b in zip(history.names, model.coefficients, strict=True):
        pred = pred + F.lit(float(b)) * F.col(name)
    if p:
        pred = pred + base
    if c is not None:
        pred = F.exp(pred) - F.lit(float(c))
    return rows.withColumn("pred_one_step", pred).drop(*history.names, "_y", "_z")


def recursive_backtest(df: DataFrame, target: str, time: str, series, cutoffs: Sequence, horizon: int, options: Mapping | None = None, low: float | None = None, high: float | None = None) -> DataFrame:
    """For each cutoff: fit on rows before it and forecast up to ``horizon`` rows from it on: ``fold, series, time, step, target, pred, pred_one_step``."""
    keys, out = as_list(series), None
    for k, cutoff in enumerate(cutoffs):
        at = F.lit(str(cutoff)).cast(df.schema[time].dataType)
        end = F.lit(str(cutoffs[k + 1])).cast(df.schema[time].dataType) if k + 1 < len(cutoffs) else None
        train = df.filter(F.col(time) < at)
        valid = df.filter(F.col(time) >= at)
        if end is not None:
            valid = valid.filter(F.col(time) < end)
        valid = step_index(valid, time, keys).filter(F.col("step") <= horizon)
        model = fit_linear_history(train, target, time, keys, **(options or {}))
        ahead = recursive_forecast(model, train, valid.select(*keys, time), target, time, keys, low, high)
        reference = one_step(model, df, target, time, keys).select(*keys, time, "pred_one_step")
        part = valid.select(*keys, time, F.col(target).alias("target")).join(ahead, [*keys, time]).join(reference, [*keys, time]).withColumn("fold", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out


def forecast_any(predict, history: DataFrame, future: DataFrame, builder: TargetHistory, time: str, series, low: float | None = None, high: float | None = None, difference: int = 0, log_offset: float | None = None) -> DataFrame:
    """``series, time, pred, step`` with any fitted model: ``predict`` maps rows with the builder's features to ``keys, time, pred``.

    With ``difference`` p the model's series is y_t - y_(t-p), with ``log_offset`` c it is log(y + c) before any difference (``model_series``); predictions come back on the scale of the target. The values that
    the inverse begins from travel with the rows that the features look back at. Without either, each step is clipped to ``low`` and ``high`` before it becomes the history of the next; with one
    of them only what is returned is clipped.

    A loop over steps on the driver; each step carries the last rows of each series and is written to the shared
    folder, so that a lost executor costs one step.
    """
    keys, target = as_list(series), builder.target
    plain, held = not difference and log_offset is None, max(builder.lookback, difference)
    steps = written(step_index(future.drop(target), time, keys).withColumns({target: F.lit(None).cast("double"), "_y": F.lit(None).cast("double")}))
    past = tail(history.select(*keys, time, F.col(target).cast("double").alias(target)), held + difference, time, keys)
    context = tail(model_series(past, target, time, keys, difference, log_offset, "_y"), held, time, keys)
    out = None
    for h in range(1, int(steps.agg(F.max("step")).first()[0] or 0) + 1):
        now = steps.filter(F.col("step") == h).drop("step")
        rows = builder.transform(context.unionByName(now, allowMissingColumns=True))
        rows = rows.withColumn("_base", F.lag("_y", difference).over(ordered(time, keys)) if difference else F.lit(0.0))
        rows = written(rows.join(now.select(*keys, time), [*keys, time], "left_semi"))
        made = predict(rows.drop("_y", "_base")).select(*keys, time, F.col("pred").cast("double").alias("pred"))
        made = made.join(rows.select(*keys, time, "_base"), [*keys, time]).withColumn("_y", F.col("pred") + F.col("_base"))
        if plain:
            made = made.withColumn("pred", clip(F.col("pred"), low, high)).withColumn("_y", F.col("pred"))
        made = written(made.drop("_base"))
        value = F.col("_y") if log_offset is None else F.exp("_y") - F.lit(float(log_offset))
        part = made.select(*keys, time, clip(value, low, high).alias("pred"), F.lit(h).alias("step"))
        out = part if out is None else out.unionByName(part)
        context = written(tail(context.unionByName(made.withColumnRenamed("pred", target)), held, time, keys))
    return out


def model_series(df: DataFrame, target: str, time: str, series, difference: int = 0, log_offset: float | None = None, level: str | None = None) -> DataFrame:
    """``df`` with the target as a model of differences or logarithms sees it: log(y + c), then less that of ``difference`` rows before (null for the first rows). ``level`` names a column for the values before the difference."""
    rows = df.withColumn(level or "_level", F.col(target).cast("double") if log_offset is None else F.log(F.col(target) + F.lit(float(log_offset))))
    moved = F.col(level or "_level") - F.lag(level or "_level", difference).over(ordered(time, series)) if difference else F.col(level or "_level")
    rows = rows.withColumn(target, moved)
    return rows if level else rows.drop("_level")


def backtest_any(fit, df: DataFrame, builder: TargetHistory, time: str, series, cutoffs: Sequence, horizon: int, low: float | None = None, high: float | None = None, difference: int = 0, log_offset: float | None = None) -> DataFrame:
    """``fold, series, time, step, target, pred`` of a recursive backtest with any model: ``fit`` maps training rows with the builder's features, in the model's scale, to the ``predict`` of ``forecast_any``.

    For each cutoff it is fitted on the rows before it and forecasts up to ``horizon`` rows from it on, to the next cutoff at most. Rows without a finite target or feature train nothing.
    """
    keys, target, out = as_list(series), builder.target, None
    kind = df.schema[time].dataType
    for k, cutoff in enumerate(cutoffs):
        train = df.filter(F.col(time) < F.lit(str(cutoff)).cast(kind))
        valid = df.filter(F.col(time) >= F.lit(str(cutoff)).cast(kind))
        if k + 1 < len(cutoffs):
            valid = valid.filter(F.col(time) < F.lit(str(cutoffs[k + 1])).cast(kind))
        valid = step_index(valid, time, keys).filter(F.col("step") <= horizon)
        predict = fit(training_rows(train, builder, time, keys, difference, log_offset))
        ahead = forecast_any(predict, train, valid.select(*keys, time), builder, time, keys, low, high, difference, log_offset)
        part = valid.select(*keys, time, F.col(target).alias("target")).join(ahead, [*keys, time]).withColumn("fold", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out


def training_rows(df: DataFrame, builder: TargetHistory, time: str, series, difference: int = 0, log_offset: float | None = None) -> DataFrame:
    """Rows with the builder's features and the target in the model's scale, all of them finite."""
    rows = builder.transform(model_series(df, builder.target, time, series, difference, log_offset))
    ok = is_finite(builder.target)
    for c in builder.names:
        ok = ok & is_finite(c)
    return rows.filter(ok)


def forecast_future(df: DataFrame, future: DataFrame, target: str, time: str, series, options: Mapping | None = None, cutoffs: Sequence = (), low: float | None = None, high: float | None = None) -> DataFrame:
    """``series, time, step, pred`` of rows after all of ``df``, each from the whole history.

    Without cutoffs by one linear model fitted on all rows; with those of a backtest by the mean of its folds' models, each fitted before its cutoff, on the scale of the target.
    """
    keys, kind = as_list(series), df.schema[time].dataType
    histories = [df.filter(F.col(time) < F.lit(str(c)).cast(kind)) for c in cutoffs] or [df]
    made = [recursive_forecast(fit_linear_history(h, target, time, keys, **(options or {})), df, future, target, time, keys, low, high) for h in histories]
    if len(made) == 1:
        return made[0]
    return reduce(DataFrame.unionByName, made).groupBy(*keys, time, "step").agg(F.avg("pred").alias("pred"))
