"""Differences of a series and their inverses, per series and in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import Learned, Learner, as_list, ordered, require
from .windows import head, tail, trailing_mean


class Difference(Learner):
    """``b_t - b_{t-p}``, where b is the value or, with ``log``, the logarithm of value + offset. The first p rows of a series are null."""

    def __init__(self, variables, order_by, series=(), periods: int = 1, log: bool = False, offset: float = 0.0):
        super().__init__(variables)
        if not isinstance(periods, int) or periods < 0 or (periods == 0 and not log):
            raise ValueError("periods must be a whole number of at least 1")
        self.order_by, self.series, self.periods, self.log, self.offset = as_list(order_by), as_list(series), periods, log, float(offset)

    def _fit(self, dataset: DataFrame) -> DifferenceModel:
        require(dataset, self.variables)
        if self.log:
            bad = dataset.agg(*[F.count_if(F.col(c) + self.offset <= 0).alias(c) for c in self.variables]).first()
            wrong = [c for c in self.variables if bad[c]]
            if wrong:
                raise ValueError(f"no logarithm of values of {wrong}: some are not positive")
        return DifferenceModel(self, dataset.select(*self.series, *self.order_by, *self.variables))


class DifferenceModel(Learned):
    """Keeps the training table (lazily) for the ends of its series; they are read only when an inverse needs them."""

    def __init__(self, spec: Difference, trained: DataFrame):
        super().__init__(spec.variables)
        self.spec, self.trained = spec, trained

    def _base(self, c: str) -> Column:
        x = F.col(c).cast("double")
        return F.when(x + self.spec.offset > 0, F.ln(x + self.spec.offset)) if self.spec.log else x

    def _transform(self, dataset: DataFrame) -> DataFrame:
        w, p = ordered(self.spec.order_by, self.spec.series), self.spec.periods
        return dataset.withColumns({c: self._base(c) - F.lag(self._base(c), p).over(w) if p else self._base(c) for c in self.variables})

    def inverse_transform(self, df: DataFrame, history: str | DataFrame | None = None) -> DataFrame:
        """Add the differences up again, each phase of the period for itself, from its anchor.

        ``history``: None if ``df`` holds the rows that were fitted (anchors from their head); "fit" if it continues them (anchors
        from their tail); or a table with the rows before. Missing anchors are an error. A null difference
        makes the rest of its phase null, and no other.
        """
        s = self.spec
        p, keys = s.periods, s.series
        back = (lambda x: F.exp(x) - s.offset) if s.log else (lambda x: x)
        if not p:
            return df.withColumns({c: back(F.col(c)) for c in self.variables})
        same = history is None
        ends = head(self.trained, p, s.order_by, keys) if same else tail(self.trained if isinstance(history, str) else history, p, s.order_by, keys)
        order = Window.partitionBy(*keys).orderBy(*s.order_by)
        anchors = ends.withColumn("_phase", F.row_number().over(order) - 1).select(*keys, "_phase", *[self._base(c).alias(f"_a_{c}") for c in self.variables])
        short = df.select(*keys).distinct() if keys else df.limit(1).select(F.lit(1).alias("_one"))
        counted = anchors.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")) if keys else anchors.agg(F.count(F.lit(1)).alias("_n"))
        lacking = (short.join(counted, keys, "left") if keys else short.crossJoin(counted)).filter(F.coalesce("_n", F.lit(0)) < p)
        if not lacking.isEmpty():
            raise ValueError(f"a series has fewer than {p} rows of history")
        rows = df.withColumn("_rn", F.row_number().over(ordered(s.order_by, keys)) - 1).withColumn("_phase", F.col("_rn") % p)
        rows = rows.join(anchors, [*keys, "_phase"], "left")
        w = Window.partitionBy(*keys, "_phase").orderBy("_rn").rowsBetween(Window.unboundedPreceding, 0)
        first = F.col("_rn") < p if same else F.lit(False)
        out = {}
        for c in self.variables:
            step = F.when(first, F.lit(0.0)).otherwise(F.col(c))
            out[c] = F.when(F.count_if(step.isNull() | F.isnan(step)).over(w) == 0, back(F.col(f"_a_{c}") + F.sum(step).over(w)))
        return rows.withColumns(out).drop("_rn", "_phase", *[f"_a_{c}" for c in self.variables])


#: kind: (period: 1, seasonal or none; logarithm)
KINDS = {"log": (0, True), "diff": (1, False), "log_diff": (1, True), "seasonal_diff": ("season", False), "log_seasonal_diff": ("season", True)}


def make_difference(kind: str, variables, order_by, series=(), season: int | None = None, offset: float = 0.0) -> Difference:
    """The transform of this name: log, diff, log_diff, seasonal_diff or log_seasonal_diff."""
    if kind not in KINDS:
        raise ValueError(f"{kind} is none of {sorted(KINDS)}")
    period, log = KINDS[kind]
    if period == "season":
        if season is None:
            raise ValueError(f"{kind} needs a season")
        period = season
    return Difference(variables, order_by, series, period, log, offset)


def six_variants(df: DataFrame, value: str, order_by, series=(), season: int = 7) -> DataFrame:
    """``raw, log, diff, log_diff, seasonal_diff, log_seasonal_diff`` of a series; values that have no logarithm are null there."""
    w = ordered(order_by, series)
    raw = F.col(value).cast("double")
    log = F.when(raw > 0, F.ln(raw))
    minus = lambda x, k: x - F.lag(x, k).over(w)
    return df.select(*as_list(series), *as_list(order_by), raw.alias("raw"), log.alias("log"), minus(raw, 1).alias("diff"), minus(log, 1).alias("log_diff"), minus(raw, season).alias("seasonal_diff"), minus(log, season).alias("log_seasonal_diff"))


VARIANTS = ("raw", "log", "diff", "log_diff", "seasonal_diff", "log_seasonal_diff")


def six_variants_long(df: DataFrame, value: str, order_by, series=(), season: int = 7) -> DataFrame:
    """The same as rows: series, order, ``variant, value``."""
    return six_variants(df, value, order_by, series, season).unpivot([*as_list(series), *as_list(order_by)], list(VARIANTS), "variant", "value")


def smoothed(df: DataFrame, value: str, order_by, series=(), window: int = 5) -> DataFrame:
    """``value_smoothed``: the trailing mean of a full window."""
    return df.withColumn(f"{value}_smoothed", trailing_mean(value, window, ordered(order_by, series)))
