"""Feature operators are pyspark.ml stages, so they fit into a Pipeline with the built-in ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Estimator, Model, Transformer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql.window import WindowSpec


def as_list(names: str | Sequence[str]) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def require(df: DataFrame, names: Sequence[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")


class Step(Transformer):
    """A transformer without state; subclasses give the new columns."""

    def __init__(self, variables: str | Sequence[str]):
        super().__init__()
        self.variables = as_list(variables)

    def columns(self, df: DataFrame) -> dict[str, Column]:
        raise NotImplementedError

    def _transform(self, dataset: DataFrame) -> DataFrame:
        require(dataset, self.variables)
        return dataset.withColumns(self.columns(dataset))


class Learned(Model):
    """A fitted stage whose state is a few numbers or a small table."""

    def __init__(self, variables: Sequence[str]):
        super().__init__()
        self.variables = list(variables)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        raise NotImplementedError


class Learner(Estimator):
    def __init__(self, variables: str | Sequence[str]):
        super().__init__()
        self.variables = as_list(variables)

    def _fit(self, dataset: DataFrame) -> Learned:
        raise NotImplementedError


def ordered(order_by: str | Sequence[str], series: str | Sequence[str] = ()) -> WindowSpec:
    """Rows of a series in order. Without a series the whole table is one: then see ``longseries`` for the distributed form."""
    return Window.partitionBy(*as_list(series)).orderBy(*as_list(order_by))
