"""Date and time features."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import Learned, Learner, Step, as_list, require

#: ISO: Monday is 1, weeks are ISO weeks.
PARTS = {"year": F.year, "month": F.month, "day": F.dayofmonth, "weekday": lambda x: F.weekday(x) + 1, "week": F.weekofyear, "hour": F.hour, "minute": F.minute, "second": F.second}
UNITS = {"s": 1.0, "min": 60.0, "h": 3600.0, "days": 86400.0}


class DateParts(Step):
    """``{c}_{part}`` for the parts asked for."""

    def __init__(self, variables, components=("year", "month", "day", "weekday")):
        super().__init__(variables)
        self.components = as_list(components)
        if unknown := [p for p in self.components if p not in PARTS]:
            raise ValueError(f"unknown parts: {unknown}")

    def columns(self, df: DataFrame) -> dict[str, Column]:
        return {f"{c}_{p}": PARTS[p](F.col(c)).cast("long") for c in self.variables for p in self.components}


class ElapsedTime(Learner):
    """``{c}_elapsed``: time since the training minimum; negative before it."""

    def __init__(self, variables, unit: str = "days"):
        super().__init__(variables)
        if unit not in UNITS:
            raise ValueError(f"the unit is one of {list(UNITS)}")
        self.unit = unit

    def _fit(self, dataset: DataFrame) -> ElapsedModel:
        require(dataset, self.variables)
        row = dataset.agg(*[F.min(F.col(c).cast("timestamp_ntz")).alias(c) for c in self.variables]).first()
        return ElapsedModel(self.variables, {c: row[c] for c in self.variables}, self.unit)


class ElapsedModel(Learned):
    def __init__(self, variables, starts: dict, unit: str):
        super().__init__(variables)
        self.starts, self.unit = starts, unit

    def _transform(self, dataset: DataFrame) -> DataFrame:
        micros = lambda c: F.timestamp_diff("MICROSECOND", F.lit(self.starts[c]).cast("timestamp_ntz"), F.col(c).cast("timestamp_ntz"))
        return dataset.withColumns({f"{c}_elapsed": micros(c) / 1e6 / UNITS[self.unit] for c in self.variables})


class Cyclical(Step):
    """``{c}_sin`` and ``{c}_cos`` with a given period."""

    def __init__(self, variables, period: float):
        super().__init__(variables)
        if period <= 0:
            raise ValueError("the period must be positive")
        self.period = float(period)

    def columns(self, df: DataFrame) -> dict[str, Column]:
        angle = lambda c: F.col(c).cast("double") * (2 * math.pi / self.period)
        return {f"{c}_{n}": f(angle(c)) for c in self.variables for n, f in (("sin", F.sin), ("cos", F.cos))}


def axis_value(c: str) -> Column:
    """A number or an ISO date and time as seconds since 1970; null if it is neither."""
    x = F.trim(F.col(c))
    return F.coalesce(x.try_cast("double"), F.unix_micros(x.try_cast("timestamp")) / 1e6)
