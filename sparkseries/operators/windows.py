"""Time-series features by window: lags, trailing averages, rates of change, steps, decimation, gaps, interpolation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import is_finite, ratio
from .base import Step, as_list, ordered, require
from .quantiles import quantiles
from .ranges import RANGE_ROWS, along


class _Windowed(Step):
    def __init__(self, variables, order_by, series=()):
        super().__init__(variables)
        self.order_by, self.series = as_list(order_by), as_list(series)

    @property
    def window(self):
        return ordered(self.order_by, self.series)


class LagFeatures(_Windowed):
    """``{c}_lag_{k}`` for every lag, each at least 1, so that no row sees itself or the future."""

    def __init__(self, variables, lags: Sequence[int], order_by, series=()):
        super().__init__(variables, order_by, series)
        self.lags = list(lags)
        if not self.lags or any(not isinstance(k, int) or k < 1 for k in self.lags):
            raise ValueError("lags must be whole numbers of at least 1")

    def columns(self, df: DataFrame) -> dict[str, Column]:
        return {f"{c}_lag_{k}": F.lag(c, k).over(self.window) for c in self.variables for k in self.lags}


def trailing_mean(c: str | Column, window: int, spec, least: int | None = None, upto: int = 0) -> Column:
    """Mean of the last ``window`` rows; null until ``least`` (all of them unless given) are not null."""
    frame = spec.rowsBetween(upto - window + 1, upto)
    x = F.col(c) if isinstance(c, str) else c
    return F.when(F.count(x).over(frame) >= (window if least is None else least), F.avg(x).over(frame))


class MovingAverage(_Windowed):
    """``{c}_ma_{w}``: the mean of the current row and those before it."""

    def __init__(self, variables, window: int, order_by, series=(), min_periods: int | None = None):
        super().__init__(variables, order_by, series)
        if window < 1 or (min_periods is not None and not 1 <= min_periods <= window):
            raise ValueError("window must be at least 1, and min_periods between 1 and window")
        self.width, self.min_periods = window, min_periods

    def columns(self, df: DataFrame) -> dict[str, Column]:
        return {f"{c}_ma_{self.width}": trailing_mean(c, self.width, self.window, self.min_periods) for c in self.variables}


class RateOfChange(_Windowed):
    """``{c}_roc_{k}``: (now - then) / then; null where then is 0."""

    def __init__(self, variables, order_by, series=(), periods: int = 1):
        super().__init__(variables, order_by, series)
        if periods < 1:
            raise ValueError("periods must be at least 1")
        self.periods = periods

    def columns(self, df: DataFrame) -> dict[str, Column]:
        out = {}
        for c in self.variables:
            before = F.lag(F.col(c).cast("double"), self.periods).over(self.window)
            out[f"{c}_roc_{self.periods}"] = ratio(F.col(c) - before, before)
        return out

    def inverse_transform(self, df: DataFrame, initial: float) -> DataFrame:
        """``{c}``: initial times the running product of 1 + rate in each series; a null rate counts as 0. One period only."""
        if self.periods != 1:
            raise NotImplementedError("only a rate over one period can be turned back")
        frame = self.window.rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({c: F.lit(float(initial)) * F.product(1 + F.coalesce(F.col(f"{c}_roc_1"), F.lit(0.0))).over(frame) for c in self.variables})


def step_index(df: DataFrame, time: str | Sequence[str], series=(), name: str = "step") -> DataFrame:
    """The place of each row in its series, from 1."""
    return df.withColumn(name, F.row_number().over(ordered(time, series)).cast("long"))


def head(df: DataFrame, n: int, order_by, series=()) -> DataFrame:
    return _ends(df, n, ordered(order_by, series))


def tail(df: DataFrame, n: int, order_by, series=()) -> DataFrame:
    """The last ``n`` rows of each series."""
    return _ends(df, n, Window.partitionBy(*as_list(series)).orderBy(*[F.desc(c) for c in as_list(order_by)]))


def _ends(df: DataFrame, n: int, window) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(window)).filter(F.col("_rn") <= n).drop("_rn")


class TargetHistory(_Windowed):
    """Features of a target's past only: ``{t}_lag_{k}``, ``{t}_lag_1_ma_{w}``, ``{t}_lag_1_roc_1``. None of them reads the current target."""

    def __init__(self, target: str, order_by, series=(), lags: Sequence[int] = (1,), windows: Sequence[int] = (), roc: bool = False):
        super().__init__([target], order_by, series)
        LagFeatures([target], list(lags), order_by, series)  # checks the lags
        self.target, self.lags, self.windows, self.roc = target, list(lags), list(windows), roc

    @property
    def lookback(self) -> int:
        """Rows before the current one that any feature reads."""
        return max([*self.lags, *self.windows, 2 if self.roc else 1])

    @property
    def names(self) -> list[str]:
        return [*(f"{self.target}_lag_{k}" for k in self.lags), *(f"{self.target}_lag_1_ma_{w}" for w in self.windows), *([f"{self.target}_lag_1_roc_1"] if self.roc else [])]

    def columns(self, df: DataFrame) -> dict[str, Column]:
        t, w = self.target, self.window
        out = {f"{t}_lag_{k}": F.lag(t, k).over(w) for k in self.lags}
        out |= {f"{t}_lag_1_ma_{n}": trailing_mean(t, n, w, upto=-1) for n in self.windows}
        if self.roc:
            out[f"{t}_lag_1_roc_1"] = ratio(F.lag(t, 1).over(w) - F.lag(t, 2).over(w), F.lag(t, 2).over(w))
        return out


def systematic_sample(df: DataFrame, most: int, order_by, series=(), range_rows: int = RANGE_ROWS) -> DataFrame:
    """Every step-th row of each series, step = max(1, rows // most), from the first row on."""
    rows = along(df, as_list(series), as_list(order_by), place="_i", totals={"_n": F.lit(1).cast("long")}, range_rows=range_rows)
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / F.lit(most)))
    return rows.filter((F.col("_i") - 1) % step == 0).drop("_i", "_n")


def random_sample(df: DataFrame, most: int, key: str, seed: int = 0) -> DataFrame:
    """At most ``most`` rows, the same for the same keys and seed."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(most)


def decimate(df: DataFrame, time: str, value: str, most: int, series=(), tiebreak: Sequence[str] = (), range_rows: int = RANGE_ROWS) -> DataFrame:
    """At most ``most`` rows of each series that keep its peaks: the least and the greatest finite value of each of most // 2 buckets of rows.

    A series of no more than ``most`` rows is kept as it is; of equal values the first in time is kept. Values that are
    not finite are in no bucket. Numbers of rows come by ranges, and the rows of a bucket meet in an aggregate only; the numbers of those to keep are joined back.
    """
    if most < 2:
        raise ValueError("two rows at least")
    keys = as_list(series)
    one, ok = F.lit(1).cast("long"), is_finite(value)
    rows = along(df, keys, [time, *tiebreak], sums={"_i": ok.cast("long")}, totals={"_n": one, "_valid": ok.cast("long")}, range_rows=range_rows)
    rows = rows.withColumn("_i", F.when(ok, F.col("_i") - 1)).withColumn("_series", F.struct(F.lit(0), *keys))
    v = F.col(value).cast("double")
    ends = rows.filter(ok & (F.col("_n") > most)).groupBy("_series", F.floor(F.col("_i") * (most // 2) / F.col("_valid")).alias("_bucket")).agg(F.min(F.struct(v, "_i"))["_i"].alias("_low"), F.min(F.struct(-v, "_i"))["_i"].alias("_high"))
    kept = ends.select("_series", F.explode(F.array_distinct(F.array("_low", "_high"))).alias("_i"), F.lit(True).alias("_end"))
    return rows.join(kept, ["_series", "_i"], "left").filter((F.col("_n") <= most) | F.col("_end")).select(*df.columns)


def gap_breaks(df: DataFrame, x: str, y: str, series=(), factor: float = 10.0, broken: str | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``y`` with null at the first row after a gap longer than ``factor`` times the series' median positive step (three rows at least).

    The median is exact, also of a series that no task holds.
    """
    keys = as_list(series)
    rows = along(df, keys, [x], previous={"_before": F.col(x).cast("double")}, totals={"_rows": F.lit(1).cast("long")}, range_rows=range_rows)
    rows = rows.withColumn("_gap", F.col(x).cast("double") - F.col("_before")).withColumn("_series", F.struct(F.lit(0), *keys))
    middle = quantiles(rows.filter(F.col("_gap") > 0), {"_median": F.col("_gap")}, [0.5], ["_series"], exact_rows=range_rows)
    rows = rows.join(middle.select("_series", F.col("_median")[0].alias("_median")), "_series", "left")
    after = F.coalesce((F.col("_rows") >= 3) & (F.col("_gap") > factor * F.col("_median")), F.lit(False))
    return rows.withColumn(broken or y, F.when(~after, F.col(y))).select(*dict.fromkeys([*df.columns, broken or y]))


def blocks(df: DataFrame, starts: Column, order_by, series=(), name: str = "block", range_rows: int = RANGE_ROWS) -> DataFrame:
    """Number the runs of rows of each series: a run begins where ``starts`` is true."""
    flag = F.coalesce(starts, F.lit(False)).cast("long")
    return along(df.withColumn("_starts", flag), as_list(series), as_list(order_by), sums={name: F.col("_starts")}, range_rows=range_rows).drop("_starts")


def change_blocks(df: DataFrame, column: str, order_by, series=(), name: str = "block", range_rows: int = RANGE_ROWS) -> DataFrame:
    """Number the runs of equal values of ``column`` of each series, from 0; a null neither begins nor ends a run."""
    rows = along(df, as_list(series), as_list(order_by), previous={"_before": F.col(column)}, range_rows=range_rows)
    return blocks(rows, F.col(column) != F.col("_before"), order_by, series, name, range_rows).drop("_before")


def interpolate(df: DataFrame, value: str, valid: Column, order_by, series=(), range_rows: int = RANGE_ROWS) -> DataFrame:
    """Replace invalid values: linearly between the valid neighbours by row number, else by the last one before, else by the next one.

    The neighbours are carried from range to range, however many invalid rows lie between.
    """
    at = F.when(F.coalesce(valid, F.lit(False)), F.struct(F.col("_i").alias("i"), F.col(value).cast("double").alias("v")))
    rows = along(df, as_list(series), as_list(order_by), place="_i", last={"_a": at}, following={"_b": at}, range_rows=range_rows)
    share = ratio(F.col("_i") - F.col("_a.i"), F.col("_b.i") - F.col("_a.i"))
    between = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * share
    filled = F.when(F.col("_a.i") == F.col("_i"), F.col("_a.v")).otherwise(F.coalesce(between, F.col("_a.v"), F.col("_b.v")))
    return rows.withColumn(value, filled).drop("_i", "_a", "_b")


def nearest_value(df: DataFrame, probes: DataFrame, time: str, value: str, at: str, series: Sequence[str] = (), range_rows: int = RANGE_ROWS) -> DataFrame:
    """Each probe with ``nearest_time`` and ``nearest_value``: the observation closest in time that is not null, the earlier of two equally close.

    One union, ordered by time within the series: each probe sees the last observation up to it and the first from it on, which are carried from range to range. Of observations
    at one time the greatest counts for later probes and those at that time, the least for earlier ones.
    """
    require(probes, [at, *series])
    keys = list(series)
    seen = df.filter(F.col(value).isNotNull() & F.col(time).isNotNull()).groupBy(*keys, F.col(time).alias("_t")).agg(F.min(F.col(value).cast("double")).alias("low"), F.max(F.col(value).cast("double")).alias("high"))
    left = probes.select(*keys, F.col(at).alias("_t"), F.lit(1).alias("_probe"), F.lit(None).cast("struct<t:timestamp_ntz,low:double,high:double>").alias("_o"))
    right = seen.select(*keys, "_t", F.lit(0).alias("_probe"), F.struct(F.col("_t").cast("timestamp_ntz").alias("t"), "low", "high").alias("_o"))
    both = along(left.unionByName(right), keys, ["_t", "_probe"], last={"_b": F.col("_o")}, following={"_a": F.col("_o")}, range_rows=range_rows, rows=df.count() + probes.count()).filter(F.col("_probe") == 1)
    gap = lambda a, b: F.timestamp_diff("MICROSECOND", a, b)
    take_after = F.col("_b").isNull() | (F.col("_a").isNotNull() & (gap(F.col("_t"), F.col("_a.t")) < gap(F.col("_b.t"), F.col("_t"))))
    return both.select(*keys, F.col("_t").alias(at), F.when(take_after, F.col("_a.t")).otherwise(F.col("_b.t")).alias("nearest_time"), F.when(take_after, F.col("_a.low")).otherwise(F.col("_b.high")).alias("nearest_value"))
