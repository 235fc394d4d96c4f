"""Combining several models' predictions on the same rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .correlogram import average_rank
from .metrics import get_metric, mse, score_by
from .ranges import RANGE_ROWS
from .ridge import ridge_cv


def join_members(members: dict[str, DataFrame], key: str = "key", keep: Sequence[str] = ("target", "fold")) -> DataFrame:
    """``key``, the columns to keep (of the first member), and one column of predictions per member."""
    (first, base), *rest = members.items()
    out = base.select(key, *keep, F.col("pred").alias(first))
    for name, df in rest:
        out = out.join(df.select(key, F.col("pred").alias(name)), key)
    return out


def mean_blend(names: Sequence[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(c) for c in names]) / len(names)


def rank_mean_blend(df: DataFrame, names: Sequence[str], output: str = "pred", range_rows: int = RANGE_ROWS) -> DataFrame:
    """The mean of each member's average ranks scaled to 0..1; a single row gets 0.5."""
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    out = df
    for c in names:
        out = average_rank(out, c, f"_r_{c}", range_rows=range_rows)
    out = out.crossJoin(F.broadcast(n))
    scaled = [F.when(F.col("_n") > 1, (F.col(f"_r_{c}") - 1) / (F.col("_n") - 1)).otherwise(0.5) for c in names]
    return out.withColumn(output, reduce(lambda a, b: a + b, scaled) / len(names)).drop("_n", *[f"_r_{c}" for c in names])


def simplex(k: int, steps: int) -> list[tuple[int, ...]]:
    """All ways to split ``steps`` among ``k`` members."""
    return [(*w, steps - sum(w)) for w in product(range(steps + 1), repeat=k - 1) if sum(w) <= steps]


def weight_grid(k: int, steps: int) -> list[tuple[float, ...]]:
    return [tuple(x / steps for x in w) for w in simplex(k, steps)]


def grid_scores(df: DataFrame, names: Sequence[str], target: str, grid: Sequence[tuple[float, ...]], fold: str | None = None) -> DataFrame:
    """``fold, weight_id, sse, n`` of every weight vector, all in one aggregate over the members' second moments.

    The squared error of a blend is a quadratic form in the weights, so its sums need the members' products only, not a
    copy of the rows per weight.
    """
    cols = [F.col(target).cast("double"), *[F.col(c).cast("double") for c in names]]
    k = len(cols)
    moments = [F.sum(cols[i] * cols[j]).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)]
    grouped = df.groupBy(fold) if fold else df.groupBy()
    sums = grouped.agg(F.count(F.lit(1)).alias("n"), *moments)

    def sse(w: Sequence[float]) -> Column:
        a = (-1.0, *w)
        return reduce(lambda x, y: x + y, [F.lit(a[i] * a[j] * (1 if i == j else 2)) * F.col(f"m{i}_{j}") for i in range(k) for j in range(i, k)])

    items = F.array(*[F.struct(F.lit(i).alias("weight_id"), sse(w).alias("sse")) for i, w in enumerate(grid)])
    keys = [fold] if fold else []
    return sums.select(*keys, "n", F.explode(items).alias("x")).select(*keys, "x.weight_id", "x.sse", "n")


def best_weights(df: DataFrame, names: Sequence[str], target: str, steps: int = 20) -> tuple[tuple[float, ...], float]:
    """The weights of the least squared error on the grid, and that error's mean."""
    grid = weight_grid(len(names), steps)
    row = grid_scores(df, names, target, grid).orderBy("sse", "weight_id").first()
    return grid[row["weight_id"]], row["sse"] / row["n"]


def cross_fit_blend(df: DataFrame, names: Sequence[str], target: str, fold: str, steps: int = 20, output: str = "pred") -> DataFrame:
    """Each fold's rows are blended with the weights that are best on the other folds: totals less the fold's own sums, without a loop over folds."""
    grid = weight_grid(len(names), steps)
    scores = grid_scores(df, names, target, grid, fold)
    others = F.sum("sse").over(Window.partitionBy("weight_id")) - F.col("sse")
    best = scores.withColumn("o", others).groupBy(fold).agg(F.min_by("weight_id", F.struct(F.round("o", 6), "weight_id")).alias("_w"))
    table = df.sparkSession.createDataFrame([(i, list(w)) for i, w in enumerate(grid)], "_w int, _weights array<double>")
    chosen = F.broadcast(best.join(F.broadcast(table), "_w").drop("_w"))
    blend = reduce(lambda a, b: a + b, [F.col("_weights")[i] * F.col(c) for i, c in enumerate(names)])
    return df.join(chosen, fold).withColumn(output, blend).drop("_weights")


def _blend_of(names: Sequence[str], weights: str = "_weights") -> Column:
    return reduce(lambda a, b: a + b, [F.get(weights, F.lit(i)) * F.col(c) for i, c in enumerate(names)])


def vector_scores(df: DataFrame, names: Sequence[str], target: str, metric: str, vectors: Sequence[tuple], sets: str | None = None) -> DataFrame:
    """``set, weight_id, score`` of weight vectors by any metric, all in one pass. ``vectors`` are (set, weight_id, weights); without ``sets``, a column of ``df``, all rows are set 0.

    Metrics that are sums over rows are added up in each task; those that order rows (areas under curves) order each vector's blends.
    """
    table = df.sparkSession.createDataFrame([(s, i, [float(x) for x in w]) for s, i, w in vectors], "set int, weight_id int, _weights array<double>")
    rows = df.select(F.col(target).alias("_y"), *names, (F.col(sets) if sets else F.lit(0)).cast("int").alias("_set"))
    rows = rows.join(F.broadcast(table), F.col("_set") == F.col("set")).select("set", "weight_id", "_y", _blend_of(names).alias("_p"))
    return score_by(rows, "_y", "_p", metric, ["set", "weight_id"])


def metric_weights(df: DataFrame, names: Sequence[str], target: str, metric: str, sets: str | None = None, steps: int = 4, rounds: int = 6) -> dict[int, tuple[tuple[float, ...], float]]:
    """For each set the weights, not negative and of sum 1, that are best by any metric, and their score; without ``sets``, a column of whole numbers, for set 0.

    Begins with a grid of the simplex, on which are the members alone, and looks in each round at the moves of half the last step from one member to
    another, so it is never worse than the best member or the grid. Each round is one pass over the rows for all sets and vectors. Equal scores go to the first vector.
    """
    better = max if get_metric(metric)[0].greater else min
    k = len(names)
    ids = [0] if sets is None else sorted(r[0] for r in df.select(F.col(sets).cast("int")).distinct().collect() if r[0] is not None)
    even = tuple(1 / k for _ in names)
    candidates = {s: [even, *weight_grid(k, steps)] for s in ids}
    best: dict[int, tuple[tuple[float, ...], float]] = {}
    step = 1 / steps
    for _ in range(rounds + 1):
        vectors = [(s, i, w) for s, ws in candidates.items() for i, w in enumerate(ws)]
        found = {(r["set"], r["weight_id"]): r["score"] for r in vector_scores(df, names, target, metric, vectors, sets).collect()}
        for s, ws in candidates.items():
            scored = [(w, found[s, i]) for i, w in enumerate(ws) if found.get((s, i)) is not None]
            options = ([best[s]] if s in best else []) + scored
            if options:
                top = better(x for _, x in options)
                best[s] = next(o for o in options if o[1] == top)
        step /= 2
        candidates = {s: _moves(w, step) for s, (w, _) in best.items()}
    return best


def _moves(w: tuple[float, ...], step: float) -> list[tuple[float, ...]]:
    """``w`` with up to ``step`` of one member's weight given to another."""
    out = []
    for i, j in product(range(len(w)), repeat=2):
        if i != j and (part := min(step, w[i])) > 0:
            out.append(tuple(x - part if m == i else x + part if m == j else x for m, x in enumerate(w)))
    return out or [w]


def blend_by_metric(df: DataFrame, names: Sequence[str], target: str, metric: str, output: str = "pred", **options) -> tuple[DataFrame, tuple[float, ...]]:
    """``df`` with the blend whose weights are best by the metric over all rows, and the weights."""
    w = metric_weights(df, names, target, metric, **options)[0][0]
    return df.withColumn(output, reduce(lambda a, b: a + b, [F.lit(x) * F.col(c) for x, c in zip(w, names, strict=True)])), w


def cross_fit_by_metric(df: DataFrame, names: Sequence[str], target: str, fold: str, metric: str, output: str = "pred", **options) -> DataFrame:
    """Each fold's rows blended with the weights that are best by the metric on the rows of the other folds; null where there are none, or for a null fold."""
    ids = sorted(r[0] for r in df.select(F.col(fold).cast("int")).distinct().collect() if r[0] is not None)
    others = F.explode(F.array(*[F.lit(k) for k in ids])) if ids else F.lit(None).cast("int")
    training = df.select(*dict.fromkeys([target, *names]), F.col(fold).cast("int").alias("_own"), others.alias("_of")).filter(F.col("_own") != F.col("_of"))
    found = metric_weights(training, names, target, metric, sets="_of", **options)
    table = df.sparkSession.createDataFrame([(s, list(w)) for s, (w, _) in found.items()], "_of int, _weights array<double>")
    return df.join(F.broadcast(table), F.col(fold).cast("int") == F.col("_of"), "left").withColumn(output, _blend_of(names)).drop("_of", "_weights")


def member_scores(df: DataFrame, names: Sequence[str], target: str) -> DataFrame:
    """``model, n, rmse``: members and blends on the same rows."""
    long = df.select(target, *[F.col(c).cast("double").alias(c) for c in names]).unpivot([target], list(names), "model", "_p")
    return long.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.sqrt(mse(target, "_p")).alias("rmse"))


def stack(df: DataFrame, names: Sequence[str], target: str, key: str, fold: str = "fold", reg: float = 0.0) -> DataFrame:
    """A linear model on the members' predictions, each fold's rows by the model of the other folds."""
    return ridge_cv(df, names, target, key, fold, reg)[0]
