"""Numeric transforms by row, and scalers that learn from the training rows only."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import ratio
from .base import Learned, Learner, Step, require
from .quantiles import quantiles


class _InPlace(Step):
    def forward(self, x: Column) -> Column:
        raise NotImplementedError

    def backward(self, y: Column) -> Column:
        raise NotImplementedError

    def columns(self, df: DataFrame) -> dict[str, Column]:
        return {c: self.forward(F.col(c).cast("double")) for c in self.variables}

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: self.backward(F.col(c)) for c in self.variables})


class Logarithm(_InPlace):
    """The logarithm of x + offset; null where that is not positive."""

    def __init__(self, variables, base: float = math.e, offset: float = 0.0):
        super().__init__(variables)
        if base <= 0 or base == 1:
            raise ValueError("the base must be positive and not 1")
        self.base, self.offset = float(base), float(offset)

    def forward(self, x: Column) -> Column:
        return F.when(x + self.offset > 0, F.ln(x + self.offset) / math.log(self.base))

    def backward(self, y: Column) -> Column:
        return F.pow(F.lit(self.base), y) - self.offset


class Reciprocal(_InPlace):
    """1 / x; null where x is 0."""

    def forward(self, x: Column) -> Column:
        return ratio(F.lit(1.0), x)

    backward = forward


class SquareRoot(_InPlace):
    """Null where x is negative."""

    def forward(self, x: Column) -> Column:
        return F.when(x >= 0, F.sqrt(x))

    def backward(self, y: Column) -> Column:
        return y * y


class Power(_InPlace):
    def __init__(self, variables, power: float):
        super().__init__(variables)
        if not power:
            raise ValueError("the power must not be 0")
        self.power = float(power)

    def forward(self, x: Column) -> Column:
        return F.pow(x, F.lit(self.power))

    def backward(self, y: Column) -> Column:
        return F.pow(y, F.lit(1 / self.power))


class ScalerModel(Learned):
    """(x - center) / scale, with ``parameters[c] = (center, scale)`` learnt from the training rows."""

    def __init__(self, variables: Sequence[str], parameters: dict[str, tuple[float, float]]):
        super().__init__(variables)
        self.parameters = parameters

    def _transform(self, dataset: DataFrame) -> DataFrame:
        require(dataset, self.variables)
        return dataset.withColumns({c: (F.col(c).cast("double") - self.parameters[c][0]) / self.parameters[c][1] for c in self.variables})

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.col(c) * self.parameters[c][1] + self.parameters[c][0] for c in self.variables})


class _Scaler(Learner):
    """One aggregate over all variables; a range of 0 counts as 1."""

    def state(self, x: Column) -> tuple[Column, Column]:
        """(center, scale) as aggregates."""
        raise NotImplementedError

    def _fit(self, dataset: DataFrame) -> ScalerModel:
        require(dataset, self.variables)
        parts = []
        for k, c in enumerate(self.variables):
            center, scale = self.state(F.col(c).cast("double"))
            parts += [center.alias(f"c{k}"), scale.alias(f"s{k}")]
        row = dataset.agg(*parts).first()
        return ScalerModel(self.variables, {c: (row[f"c{k}"] or 0.0, row[f"s{k}"] or 1.0) for k, c in enumerate(self.variables)})


class MinMaxScaler(_Scaler):
    """To [0, 1]; a constant becomes 0."""

    def state(self, x: Column) -> tuple[Column, Column]:
        return F.min(x), F.max(x) - F.min(x)


class RobustScaler(_Scaler):
    """The median and the distance of two quantiles, 25 and 75 percent unless given, interpolated linearly and exact at any size."""

    def __init__(self, variables, quantile_range: tuple[float, float] = (25.0, 75.0)):
        super().__init__(variables)
        low, high = quantile_range
        if not 0 <= low < high <= 100:
            raise ValueError("quantiles must be ascending percentages")
        self.low, self.high = low / 100, high / 100

    def _fit(self, dataset: DataFrame) -> ScalerModel:
        require(dataset, self.variables)
        row = quantiles(dataset, {c: F.col(c) for c in self.variables}, [0.5, self.low, self.high]).first()
        found = {c: row[c] or [0.0, 0.0, 0.0] for c in self.variables}
        return ScalerModel(self.variables, {c: (middle, (high - low) or 1.0) for c, (middle, low, high) in found.items()})


class MeanNormalizer(_Scaler):
    """(x - mean) / (max - min); a constant becomes 0."""

    def state(self, x: Column) -> tuple[Column, Column]:
        return F.avg(x), F.max(x) - F.min(x)


class MaxAbsScaler(_Scaler):
    def state(self, x: Column) -> tuple[Column, Column]:
        return F.lit(0.0), F.max(F.abs(x))


class StandardImputer(_Scaler):
    """Fill nulls and NaN by the median, then standardise by mean and population deviation of the filled values."""

    def _fit(self, dataset: DataFrame) -> StandardImputerModel:
        require(dataset, self.variables)
        clean = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
        middle = quantiles(dataset, {c: clean(c) for c in self.variables}, [0.5]).first().asDict()
        fill = {c: (v[0] if v is not None else 0.0) for c, v in middle.items()}
        filled = {c: F.coalesce(clean(c), F.lit(fill[c])) for c in self.variables}
        row = dataset.agg(*[f(filled[c]).alias(f"{n}{k}") for k, c in enumerate(self.variables) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        return StandardImputerModel(self.variables, {c: (row[f"m{k}"] or 0.0, row[f"s{k}"] or 1.0) for k, c in enumerate(self.variables)}, fill)


class StandardImputerModel(ScalerModel):
    def __init__(self, variables, parameters, fill: dict[str, float]):
        super().__init__(variables, parameters)
        self.fill = fill

    def _transform(self, dataset: DataFrame) -> DataFrame:
        filled = {c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(self.fill[c])) for c in self.variables}
        return super()._transform(dataset.withColumns(filled))


def power_expression(x: Column, lam: float, method: str) -> Column:
    """Box-Cox or Yeo-Johnson with this exponent."""
    if method == "box-cox":
        return F.when(x > 0, F.ln(x) if lam == 0 else (F.pow(x, F.lit(lam)) - 1) / lam)
    up = F.log1p(x) if lam == 0 else (F.pow(x + 1, F.lit(lam)) - 1) / lam
    down = -F.log1p(-x) if lam == 2 else -(F.pow(1 - x, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(x >= 0, up).otherwise(down)


#: Powers of the distance to its middle that are summed in a range, and the width of a range times the largest exponent: what is cut off is under 1e-13 of a variance.
MOMENTS, REACH = 8, 1 / 16
#: Ranges of a column at least.
LEAST_RANGES = 64


class PowerTransformer(Learner):
    """Box-Cox or Yeo-Johnson; the exponent of the greatest likelihood is searched on grids.

    The rows are read twice, for limits and for sums by ranges of the logarithm: within a range the transformed value is a power series in the distance to the range's middle, so sums of its powers give the
    variance under any exponent. They are a table of a bounded number of rows (64 at least, usually some hundreds a column), from which all grids follow.
    """

    def __init__(self, variables, method: str = "yeo-johnson", passes: int = 5, points: int = 17, span: tuple[float, float] = (-5.0, 5.0)):
        super().__init__(variables)
        if method not in ("yeo-johnson", "box-cox"):
            raise ValueError("the method is yeo-johnson or box-cox")
        self.method, self.passes, self.points, self.span = method, passes, points, span

    def _fit(self, dataset: DataFrame) -> PowerModel:
        require(dataset, self.variables)
        xs = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in self.variables]
        row = dataset.agg(*[f(x).alias(f"{n}{i}") for i, x in enumerate(xs) for n, f in (("a", F.min), ("b", F.max))]).first()
        limits = [(row[f"a{i}"], row[f"b{i}"]) for i in range(len(xs))]
        if self.method == "box-cox" and (wrong := [c for c, (a, _) in zip(self.variables, limits, strict=True) if a is not None and a <= 0]):
            raise ValueError(f"Box-Cox needs positive values: {wrong}")
        sums = self._sums(dataset, xs, limits)
        lambdas = {}
        for i, c in enumerate(self.variables):
            lo, hi = self.span
            for _ in range(self.passes):
                grid = [lo + (hi - lo) * k / (self.points - 1) for k in range(self.points)]
                score = [_likelihood(sums[i], lam) if i in sums else -math.inf for lam in grid]
                k = max(range(self.points), key=score.__getitem__)
                lo, hi = grid[max(0, k - 1)], grid[min(self.points - 1, k + 1)]
            lambdas[c] = (lo + hi) / 2
        return PowerModel(self.variables, lambdas, self.method)

    def _sums(self, dataset: DataFrame, xs: Sequence[Column], limits: Sequence[tuple]) -> dict[int, np.ndarray]:
        """Of each column whose values are finite and differ: for each range with values its sign, middle, number of values and sums of powers of the distance to the middle."""
        log = math.log if self.method == "box-cox" else lambda x: math.copysign(math.log1p(abs(x)), x)
        ends = [abs(e) for e in self.span] + ([abs(2 - e) for e in self.span] if self.method == "yeo-johnson" else [])
        spans, items = {}, []
        for i, (x, (a, b)) in enumerate(zip(xs, limits, strict=True)):
            if a is None or a == b or not (math.isfinite(a) and math.isfinite(b)) or not (low := log(a)) < (high := log(b)):
                continue
            spans[i] = low, min(REACH / max(1.0, *ends), (high - low) / LEAST_RANGES)
            u = F.ln(x) if self.method == "box-cox" else F.signum(x) * F.log1p(F.abs(x))
            items.append(F.struct(F.lit(i).alias("i"), (u - spans[i][0]).alias("u"), F.lit(spans[i][1]).alias("w"), (F.lit(False) if self.method == "box-cox" else x < 0).alias("down")))
        if not items:
            return {}
        rows = dataset.select(F.inline(F.array(*items))).filter("u is not null")
        rows = rows.select("i", "w", "down", "u", F.floor(F.col("u") / F.col("w")).alias("k")).select("i", "down", "k", (F.col("u") - (F.col("k") + 0.5) * F.col("w")).alias("d"))
        powers = [F.col("d")]
        for _ in range(MOMENTS - 1):
            powers.append(powers[-1] * F.col("d"))
        found: dict[int, list] = {}
        for r in rows.groupBy("i", "down", "k").agg(F.count(F.lit(1)), *map(F.sum, powers)).collect():
            low, width = spans[r[0]]
            side = -1 if r[1] else 1
            found.setdefault(r[0], []).append([side, side * (low + (r[2] + 0.5) * width), r[3], *(v * side ** (j + 1) for j, v in enumerate(r[4:]))])
        return {i: np.array(v, dtype=float) for i, v in found.items()}


def _likelihood(sums: np.ndarray, lam: float) -> float:
    """The log-likelihood of an exponent from the sums of ranges (``PowerTransformer._sums``); -inf where the variance is 0 or no number."""
    side, middle, n, first = sums[:, 0], sums[:, 1], sums[:, 2], sums[:, 3]
    count, logs = n.sum(), side @ (n * middle + first)
    e = np.where(side > 0, lam, 2 - lam)
    # on one side of 0 a factor may be taken out, here that of the mean, so that differences stay exact
    shift = (n @ middle + first.sum()) / count if (side == side[0]).all() else 0.0
    at = middle - shift
    with np.errstate(all="ignore"):
        # with d the distance to the middle, a value is scale * f(d) + base, f(d) = (exp(e d) - 1) / e
        scale, base = np.exp(e * at), np.where(e == 0, at, np.expm1(e * at) / np.where(e == 0, 1, e))
        f1 = sum(e ** (j - 1) * sums[:, 2 + j] / math.factorial(j) for j in range(1, MOMENTS + 1))
        f2 = sum((2**j - 2) * e ** (j - 2) * sums[:, 2 + j] / math.factorial(j) for j in range(2, MOMENTS + 1))
        means = side * (scale * f1 / n + base)
        v = float((scale**2 * (f2 - f1**2 / n)).sum() + n @ (means - (n @ means) / count) ** 2) / count
    if not (v > 0 and math.isfinite(v)):
        return -math.inf
    return float(-0.5 * count * (math.log(v) + 2 * e[0] * shift) + (lam - 1) * logs)


class PowerModel(Learned):
    def __init__(self, variables, lambdas: dict[str, float], method: str):
        super().__init__(variables)
        self.lambdas, self.method = lambdas, method

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumns({c: power_expression(F.col(c).cast("double"), self.lambdas[c], self.method) for c in self.variables})

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        out = {}
        for c in self.variables:
            y, lam = F.col(c), self.lambdas[c]
            up = F.exp(y) if lam == 0 else F.pow(y * lam + 1, F.lit(1 / lam))
            if self.method == "box-cox":
                out[c] = up
            else:
                down = 1 - (F.exp(-y) if lam == 2 else F.pow(1 - (2 - lam) * y, F.lit(1 / (2 - lam))))
                out[c] = F.when(y >= 0, up - 1).otherwise(down)
        return df.withColumns(out)
