"""Categorical encoders whose state is learnt from the training rows only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import ratio
from .base import Learned, Learner, require
from .ranges import along, written

#: A learned table is broadcast only up to this many categories; beyond that it is joined by shuffle.
BROADCAST_CATEGORIES = 1_000_000
#: Categories of a one-hot encoding, or classes of a target, at most: the driver holds them.
MOST_CATEGORIES = 10_000


def lookup(df: DataFrame, variable: str, table: DataFrame, rows: int) -> DataFrame:
    """Join a learned table (``category`` and values) to a variable."""
    small = F.broadcast(table) if rows <= BROADCAST_CATEGORIES else table
    return df.join(small, df[variable].cast("string").eqNullSafe(F.col("category")), "left").drop("category")


class OneHotEncoder(Learner):
    """``{c}_{category}`` columns of 0 and 1 beside the original; unseen values are 0 everywhere.

    Categories with fewer than ``min_frequency`` rows (a count, or a share below 1), or beyond the ``max_categories - 1``
    most frequent, go to ``{c}_infrequent``. More than MOST_CATEGORIES categories, each of which would be a column or a literal, are an error.
    """

    def __init__(self, variables, min_frequency: float | None = None, max_categories: int | None = None):
        super().__init__(variables)
        self.min_frequency, self.max_categories = min_frequency, max_categories

    def _fit(self, dataset: DataFrame) -> OneHotModel:
        require(dataset, self.variables)
        total, kept, rare = dataset.count(), {}, {}
        for c in self.variables:
            counts = dataset.filter(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("v")).agg(F.count(F.lit(1)).alias("n"))
            rows = [(r["v"], r["n"]) for r in counts.limit(MOST_CATEGORIES + 1).collect()]
            if len(rows) > MOST_CATEGORIES:
                raise ValueError(f"{c} has more than {MOST_CATEGORIES} categories; group the rare ones first (RareGrouper)")
            least = 0 if self.min_frequency is None else self.min_frequency * total if isinstance(self.min_frequency, float) and self.min_frequency < 1 else self.min_frequency
            few = {v for v, n in rows if n < least}
            if self.max_categories is not None and len(rows) - len(few) + bool(few) > self.max_categories:
                by_count = sorted((x for x in rows if x[0] not in few), key=lambda x: (-x[1], x[0]))
                few |= {v for v, _ in by_count[self.max_categories - 1 :]}
            kept[c], rare[c] = sorted(v for v, _ in rows if v not in few), sorted(few)
        return OneHotModel(self.variables, kept, rare)


class OneHotModel(Learned):
    def __init__(self, variables, kept: dict[str, list[str]], rare: dict[str, list[str]]):
        super().__init__(variables)
        self.kept, self.rare = kept, rare

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out: dict[str, Column] = {}
        for c in self.variables:
            x = F.col(c).cast("string")
            out |= {f"{c}_{v}": F.coalesce((x == v).cast("double"), F.lit(0.0)) for v in self.kept[c]}
            if self.rare[c]:
                out[f"{c}_infrequent"] = F.coalesce(x.isin(self.rare[c]).cast("double"), F.lit(0.0))
        return dataset.withColumns(out)


class LookupModel(Learned):
    """Values by category, in small tables; ``default`` for unseen ones."""

    def __init__(self, variables, tables: dict[str, DataFrame], default: dict[str, float | None]):
        super().__init__(variables)
        self.tables, self.default = tables, default
        self.rows = {c: t.count() for c, t in tables.items()}

    def _transform(self, dataset: DataFrame) -> DataFrame:
        names = dataset.columns
        for c in self.variables:
            dataset = lookup(dataset, c, self.tables[c].withColumnRenamed("value", f"_{c}_value"), self.rows[c])
            value = F.col(f"_{c}_value")
            dataset = dataset.withColumn(c, value if self.default.get(c) is None else F.coalesce(value, F.lit(self.default[c]))).drop(f"_{c}_value")
        return dataset.select(*names)


class OrdinalEncoder(Learner):
    """0, 1, ... in the order of the categories; unseen ones are null."""

    def _fit(self, dataset: DataFrame) -> LookupModel:
        require(dataset, self.variables)
        tables = {}
        for c in self.variables:
            seen = dataset.filter(F.col(c).isNotNull()).select(F.col(c).alias("v")).distinct()
            tables[c] = written(along(written(seen), [], ["v"], place="_k").select(F.col("v").cast("string").alias("category"), (F.col("_k") - 1).cast("double").alias("value")))
        return LookupModel(self.variables, tables, {})


class _ByTarget(Learner):
    def __init__(self, variables, target: str):
        super().__init__(variables)
        self.target = target

    def sums(self, dataset: DataFrame, c: str) -> DataFrame:
        y = F.col(self.target).cast("double")
        return dataset.filter(F.col(c).isNotNull() & y.isNotNull()).groupBy(F.col(c).cast("string").alias("category")).agg(F.sum(y).alias("s"), F.count(y).alias("n"))


class TargetOrdinalEncoder(_ByTarget):
    """0, 1, ... by ascending mean of the target, ties by category; unseen ones are null."""

    def _fit(self, dataset: DataFrame) -> LookupModel:
        require(dataset, [*self.variables, self.target])
        means = {c: written(self.sums(dataset, c).select("category", (F.col("s") / F.col("n")).alias("_mean"))) for c in self.variables}
        tables = {c: written(along(m, [], ["_mean", "category"], place="_k").select("category", (F.col("_k") - 1).cast("double").alias("value"))) for c, m in means.items()}
        return LookupModel(self.variables, tables, {})


class TargetEncoder(_ByTarget):
    """(sum + m * mean of all) / (n + m); unseen ones get the mean of all."""

    def __init__(self, variables, target: str, smoothing: float = 0.0):
        super().__init__(variables, target)
        self.smoothing = float(smoothing)

    def _fit(self, dataset: DataFrame) -> LookupModel:
        require(dataset, [*self.variables, self.target])
        mean = dataset.agg(F.avg(F.col(self.target).cast("double"))).first()[0]
        value = (F.col("s") + self.smoothing * F.lit(mean)) / (F.col("n") + self.smoothing)
        tables = {c: written(self.sums(dataset, c).select("category", value.alias("value"))) for c in self.variables}
        return LookupModel(self.variables, tables, dict.fromkeys(self.variables, mean))

    def fit_transform(self, df: DataFrame, fold: str) -> DataFrame:
        """Training rows by the other folds' statistics only: totals less those of the row's own fold, in one pass per variable."""
        y = F.col(self.target).cast("double")
        by_fold = df.groupBy(fold).agg(F.sum(y).alias("_fs"), F.count(y).alias("_fn"))
        every = by_fold.select(F.col(fold), (F.sum("_fs").over(Window.partitionBy()) - F.col("_fs")).alias("_gs"), (F.sum("_fn").over(Window.partitionBy()) - F.col("_fn")).alias("_gn"))
        out = df.join(F.broadcast(every.select(fold, ratio("_gs", "_gn").alias("_mean"))), fold, "left")
        for c in self.variables:
            part = df.groupBy(c, fold).agg(F.sum(y).alias("_s"), F.count(y).alias("_n"))
            whole = Window.partitionBy(c)
            others = part.select(c, fold, (F.sum("_s").over(whole) - F.col("_s")).alias("_os"), (F.sum("_n").over(whole) - F.col("_n")).alias("_on")).withColumnsRenamed({c: "_c", fold: "_f"})
            out = out.join(others, out[c].eqNullSafe(F.col("_c")) & (out[fold] == F.col("_f")), "left").drop("_c", "_f")
            value = ratio(F.col("_os") + self.smoothing * F.col("_mean"), F.col("_on") + self.smoothing)
            out = out.withColumn(c, F.coalesce(value, F.col("_mean"))).drop("_os", "_on")
        return out.select(*df.columns)


class RareGrouper(Learner):
    """Categories with too few rows, and unseen ones, become ``other``; null stays. At least one threshold is needed."""

    def __init__(self, variables, min_frequency: int | None = None, min_ratio: float | None = None, other: str = "Other"):
        super().__init__(variables)
        if min_frequency is None and min_ratio is None:
            raise ValueError("a least frequency or a least ratio is needed")
        self.min_frequency, self.min_ratio, self.other = min_frequency, min_ratio, other

    def _fit(self, dataset: DataFrame) -> RareModel:
        require(dataset, self.variables)
        total, tables = dataset.count(), {}
        least = max(self.min_frequency or 0, (self.min_ratio or 0) * total)
        for c in self.variables:
            counts = dataset.filter(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("category")).agg(F.count(F.lit(1)).alias("n"))
            tables[c] = written(counts.filter(F.col("n") >= least).select("category", F.col("category").alias("value")))
        return RareModel(self.variables, tables, self.other)


class RareModel(LookupModel):
    def __init__(self, variables, tables, other: str):
        super().__init__(variables, tables, {})
        self.other = other

    def _transform(self, dataset: DataFrame) -> DataFrame:
        flags = {f"_null_{c}": F.col(c).isNull() for c in self.variables}
        out = super()._transform(dataset.withColumns(flags))
        return out.withColumns({c: F.when(~F.col(f"_null_{c}"), F.coalesce(F.col(c), F.lit(self.other))) for c in self.variables}).drop(*flags)


def encode_target(df: DataFrame, target: str, binary: bool = False, name: str = "label") -> tuple[DataFrame, list]:
    """0..K-1 in the order of the classes, and the classes. A null is an error, as are more than MOST_CATEGORIES classes, or other than two if ``binary``."""
    classes = [r[0] for r in df.select(target).distinct().orderBy(F.col(target).asc_nulls_first()).limit(MOST_CATEGORIES + 1).collect()]
    if len(classes) > MOST_CATEGORIES:
        raise ValueError(f"more than {MOST_CATEGORIES} classes")
    if classes and classes[0] is None:
        raise ValueError("the target has nulls")
    if binary and len(classes) != 2:
        raise ValueError(f"two classes are needed, not {len(classes)}")
    label = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(target)) - 1
    return df.withColumn(name, label.cast("int")), classes
