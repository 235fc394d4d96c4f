"""Column roles, row filters, wide and long forms, unions, distinct rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Transformer
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import as_list, require


def time_column(df: DataFrame) -> str | None:
    """The first date or timestamp column."""
    return next((f.name for f in df.schema if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))), None)


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def feature_columns(df: DataFrame, target: str, id_column: str | None = None, drop: Sequence[str] = (), features: Sequence[str] | None = None) -> list[str]:
    """The columns asked for, or all but the target, the id and those to drop."""
    if features is not None:
        require(df, features)
        return list(features)
    return [c for c in df.columns if c not in {target, id_column, *drop}]


class DropColumns(Transformer):
    """Drops columns; one that is missing is an error."""

    def __init__(self, columns: str | Sequence[str]):
        super().__init__()
        self.names = as_list(columns)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        require(dataset, self.names)
        return dataset.drop(*self.names)


class ModelInput(Transformer):
    """A vector of numeric or boolean columns in a fixed order; other types are named in an error."""

    def __init__(self, columns: Sequence[str], output: str = "features"):
        super().__init__()
        self.names, self.output = list(columns), output

    def _transform(self, dataset: DataFrame) -> DataFrame:
        require(dataset, self.names)
        wrong = [c for c in self.names if not isinstance(dataset.schema[c].dataType, (T.NumericType, T.BooleanType))]
        if wrong:
            raise TypeError(f"not numeric: {wrong}")
        return VectorAssembler(inputCols=self.names, outputCol=self.output, handleInvalid="keep").transform(dataset)


@dataclass(frozen=True)
class SeriesSpec:
    """Which series of a table: its time and value columns, and the group it is in."""

    time: str
    value: str
    group: str | None = None
    group_value: str | None = None

    @property
    def label(self) -> str:
        return self.value if self.group is None else f"{self.value} ({self.group}={self.group_value})"


def select_series(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """``time, value`` of one series: dates as timestamps, values as doubles, rows without a time left out."""
    rows = df if spec.group is None else df.filter(F.col(spec.group).cast("string") == F.lit(str(spec.group_value)))
    return rows.filter(F.col(spec.time).isNotNull()).select(F.col(spec.time).cast("timestamp_ntz").alias("time"), F.col(spec.value).cast("double").alias("value"))


def in_range(df: DataFrame, column: str, low=None, high=None) -> DataFrame:
    """Rows with low <= column <= high; an open side is None. Reaches the scan as a pushed filter."""
    if low is not None:
        df = df.filter(F.col(column) >= F.lit(low))
    if high is not None:
        df = df.filter(F.col(column) <= F.lit(high))
    return df


def to_long(df: DataFrame, ids: Sequence[str], values: Sequence[str], variable: str = "variable", value: str = "value") -> DataFrame:
    return df.select(*ids, *[F.col(c).cast("double").alias(c) if isinstance(df.schema[c].dataType, T.NumericType) else c for c in values]).unpivot(list(ids), list(values), variable, value)


def to_wide(df: DataFrame, ids: Sequence[str], variable: str, value: str, names: Sequence[str]) -> DataFrame:
    """One column per name; naming them saves a pass over the data."""
    return df.groupBy(*ids).pivot(variable, list(names)).agg(F.first(value))


def sentinel_to_null(c: str, sentinel: str) -> Column:
    return F.nullif(F.col(c), F.lit(sentinel))


def out_of_range(df: DataFrame, ranges: Mapping[str, tuple[float, float]], ids: Sequence[str]) -> DataFrame:
    """A row for each value outside its variable's bounds: ids, ``variable, value, low, high``. Nulls are inside. One scan for all variables."""
    bounds = F.create_map(*[x for v, (lo, hi) in ranges.items() for x in (F.lit(v), F.struct(F.lit(float(lo)).alias("low"), F.lit(float(hi)).alias("high")))])
    rows = to_long(df, ids, list(ranges)).withColumn("_b", bounds[F.col("variable")])
    rows = rows.select(*ids, "variable", "value", "_b.low", "_b.high")
    return rows.filter((F.col("value") < F.col("low")) | (F.col("value") > F.col("high")))


def is_valid(variable: Column, value: Column, restricted: str, low: float, high: float) -> Column:
    """Whether an observation counts: only one variable has bounds; a null does not count."""
    return F.coalesce(F.when(variable == restricted, value.between(low, high)).otherwise(value.isNotNull()), F.lit(False))


def before_test(train: DataFrame, test: DataFrame, time: str, columns: Sequence[str]) -> DataFrame:
    """Training rows before the first test time, with the columns needed; the one-row minimum is broadcast."""
    first = test.agg(F.min(time).alias("_first"))
    return train.join(F.broadcast(first), F.col(time) < F.col("_first")).select(*columns)


def relaxed_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union by name; a column of two numeric types becomes double, of other different types string."""
    kinds = {}
    for f in a.schema:
        other = next((g for g in b.schema if g.name == f.name), None)
        if other is not None and other.dataType != f.dataType:
            kinds[f.name] = "double" if isinstance(f.dataType, T.NumericType) and isinstance(other.dataType, T.NumericType) else "string"
    cast = lambda df: df.withColumns({c: F.col(c).cast(k) for c, k in kinds.items()}) if kinds else df
    return cast(a).unionByName(cast(b), allowMissingColumns=True)


def distinct_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_rn") == 1).drop("_rn")
