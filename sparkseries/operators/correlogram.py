"""Autocorrelation, partial autocorrelation and the tests built on them, for many series at once."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import correlation, is_finite, ratio
from .base import as_list
from .quantiles import quantiles
from .ranges import RANGE_ROWS, along, with_past


def acf(df: DataFrame, value: str, order_by, series=(), nlags: int = 40, max_points: int | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``series, n, lag, acf`` for lags 0 to min(nlags, n - 1); nulls are left out first; series of fewer than ten values have no rows.

    ``max_points`` keeps the latest values only. Series are cut into chunks of about ``range_rows`` that overlap by the lags; one window for the centred values and those before them, one aggregate for all lags. A
    constant series has null beyond lag 0.
    """
    keys, order = as_list(series), as_list(order_by)
    rows = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(F.struct(F.lit(0), *keys).alias("_g"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.col(value).cast("double").alias("_v"))
    order = [f"_o{i}" for i in range(len(order))]
    if max_points:
        rows = along(rows, ["_g"], order, place="_rn", descending=True, range_rows=range_rows).filter(F.col("_rn") <= max_points).drop("_rn")
    means = rows.groupBy("_g").agg(F.avg("_v").alias("_m"))
    past, by, place, own = with_past(rows.join(means, "_g").select("_g", *order, (F.col("_v") - F.col("_m")).alias("_x")), ["_g"], order, nlags, range_rows)
    w = Window.partitionBy(*by).orderBy(place)
    products = F.transform(F.array(*[F.lag("_x", k).over(w) if k else F.col("_x") for k in range(nlags + 1)]), lambda y: y * F.col("_x"))
    sums = past.withColumn("_p", products).filter(own).groupBy("_g").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("_p")[k]).alias(f"_s{k}") for k in range(nlags + 1)]).filter(F.col("n") >= 10)
    out = sums.select("_g", "n", F.posexplode(F.array(*[F.col(f"_s{k}") / F.nullif(F.col("_s0"), F.lit(0.0)) for k in range(nlags + 1)])).alias("lag", "acf"))
    return out.filter(F.col("lag") < F.col("n")).select(*[F.col(f"_g.`{k}`").alias(k) for k in keys], "n", F.col("lag").cast("long").alias("lag"), F.when(F.col("lag") == 0, F.lit(1.0)).otherwise(F.col("acf")).alias("acf"))


def partial_from_acf(r: Sequence[float]) -> list[float]:
    """Durbin and Levinson's recursion from autocorrelations at lags 0, 1, ..."""
    out, phi = [1.0], np.zeros(0)
    for k in range(1, len(r)):
        past = np.asarray(r[1:k])
        below = 1.0 - float(phi @ past) if k > 1 else 1.0
        last = (r[k] - float(phi @ past[::-1])) / below if below else float("nan")
        phi = np.concatenate([phi - last * phi[::-1], [last]])
        out.append(float(last))
    return out


def pacf(df: DataFrame, value: str, order_by, series=(), nlags: int = 40, adjusted: bool = False) -> DataFrame:
    """``series, n, lag, pacf`` for lags under n / 2, by Yule and Walker. ``adjusted`` divides the sum at lag k by n - k instead of n."""
    keys = as_list(series)
    r = F.col("acf") * F.col("n") / (F.col("n") - F.col("lag")) if adjusted else F.col("acf")
    found = acf(df, value, order_by, keys, nlags).filter(2 * F.col("lag") < F.col("n")).withColumn("acf", r)
    arrays = found.groupBy(*keys, "n").agg(F.array_sort(F.collect_list(F.struct("lag", "acf"))).alias("r"))

    def recurse(batches):
        for batch in batches:
            rs = [[x["acf"] if x["acf"] is not None else float("nan") for x in r] for r in batch["r"]]
            yield batch[[*keys, "n"]].assign(pacf=[partial_from_acf(r) for r in rs])

    schema = T.StructType([*(arrays.schema[c] for c in [*keys, "n"]), T.StructField("pacf", T.ArrayType(T.DoubleType()))])
    return arrays.mapInPandas(recurse, schema).select(*keys, "n", F.posexplode("pacf").alias("lag", "pacf")).withColumn("lag", F.col("lag").cast("long")).withColumn("pacf", F.nanvl("pacf", F.lit(None).cast("double")))


def band(n: Column) -> Column:
    """Half the width of the 95 percent band of a correlogram."""
    return F.lit(1.96) / F.sqrt(n)


def series_checks(df: DataFrame, time: str, values: Sequence[str], series=(), nlags: int = 40, season: int = 7) -> DataFrame:
    """Autocorrelations of every series, numeric column and variant (raw, logarithm, differences) in one pass: ``series, column, variant, n, lag, acf, band``.

    Nothing where a series has two rows at one time.
    """
    from .difference import six_variants_long

    keys = as_list(series)
    twice = df.groupBy(*keys, time).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1).select(*keys).distinct()
    rows = df.select(*keys, time, *[F.col(c).cast("double").alias(c) for c in values])
    rows = rows.join(twice, keys, "left_anti") if keys else rows.join(twice.limit(1).select(F.lit(True).alias("_t")), F.col("_t"), "left_anti")
    long = rows.unpivot([*keys, time], list(values), "column", "_value")
    variants = six_variants_long(long, "_value", time, [*keys, "column"], season)
    return acf(variants, "value", time, [*keys, "column", "variant"], nlags).withColumn("band", band(F.col("n")))


def jarque_bera(df: DataFrame, value: str, series=()) -> DataFrame:
    """``series, n, skewness, kurtosis, jb, p_value`` over finite values; null for a constant."""
    v = F.when(is_finite(value), F.col(value).cast("double"))
    keys = as_list(series)
    one = df.groupBy(*keys).agg(F.count(v).alias("n"), F.skewness(v).alias("skewness"), F.kurtosis(v).alias("kurtosis"))
    jb = F.col("n") / 6.0 * (F.pow("skewness", F.lit(2)) + F.pow("kurtosis", F.lit(2)) / 4.0)
    return one.withColumn("jb", jb).withColumn("p_value", F.exp(-F.col("jb") / 2))


def chi2_tail(x: float, k: int) -> float:
    """P(X > x) for a chi-squared variable with k degrees of freedom, by the finite sums for even and odd k."""
    if x is None or k < 1 or not math.isfinite(x):
        return float("nan")
    h = x / 2
    if k % 2 == 0:
        term, total = 1.0, 1.0
        for j in range(1, k // 2):
            term *= h / j
            total += term
        return math.exp(-h) * total
    total, term = math.erfc(math.sqrt(h)), math.sqrt(h) * math.exp(-h) / math.gamma(1.5)
    for j in range(1, (k - 1) // 2 + 1):
        total += term
        term *= h / (j + 0.5)
    return total


@F.pandas_udf(T.DoubleType())
def _chi2(x: pd.Series, k: pd.Series) -> pd.Series:
    return pd.Series([chi2_tail(a, int(b)) for a, b in zip(x, k, strict=True)])


def ljung_box(df: DataFrame, value: str, order_by, series=(), lags: Sequence[int] | None = None, period: int | None = None, model_df: int = 0) -> DataFrame:
    """``series, n, lag, q, p_value``: Q = n (n + 2) times the sum of r_k^2 / (n - k).

    Default lags: max(1, min(10, n // 5)), and the seasonal period if it is under n // 2. Lags kept: model_df < lag < n // 2. Series of fewer than
    eight values or without variation have no rows.
    """
    keys = as_list(series)
    most = max([10, period or 0, *(lags or [])])
    found = acf(df, value, order_by, keys, most).filter((F.col("lag") > 0) & F.col("acf").isNotNull())
    running = F.sum(F.col("acf") * F.col("acf") / (F.col("n") - F.col("lag"))).over(Window.partitionBy(*keys).orderBy("lag").rowsBetween(Window.unboundedPreceding, 0))
    rows = found.withColumn("q", F.col("n") * (F.col("n") + 2) * running)
    if lags is None:
        wanted = F.col("lag") == F.greatest(F.lit(1), F.least(F.lit(10), F.floor(F.col("n") / 5)))
        if period:
            wanted = wanted | ((F.col("lag") == period) & (F.lit(period) < F.floor(F.col("n") / 2)))
    else:
        wanted = F.col("lag").isin([int(k) for k in lags])
    kept = rows.filter(wanted & (F.col("lag") > model_df) & (F.col("lag") < F.floor(F.col("n") / 2)) & (F.col("n") >= 8))
    return kept.select(*keys, "n", "lag", "q", _chi2("q", F.col("lag") - model_df).alias("p_value"))


def residual_tests(df: DataFrame, residual: str, order_by, series, level: float = 0.05, *, lags: Sequence[int] | None = None, period: int | None = None, model_df: int = 0, regression: str = "c") -> DataFrame:
    """One row per series: the Ljung-Box test at its greatest lag, Jarque-Bera, ADF and KPSS, and what each says at ``level``.

    ``autocorrelation`` (found, not found), ``normality`` (rejected, not rejected) and ``stationarity`` (the verdict of ``unit_root``) are "not computed" where a test is. ``ljung_box`` with the same
    arguments has all lags.
    """
    from .unitroot import unit_root

    keys = as_list(series)
    greatest = F.max_by(F.struct(F.col("lag").alias("lb_lag"), F.col("q").alias("lb_q"), F.col("p_value").alias("lb_p")), "lag")
    box = ljung_box(df, residual, order_by, keys, lags, period, model_df).groupBy(*keys).agg(greatest.alias("_b")).select(*keys, "_b.*")
    normal = jarque_bera(df, residual, keys).select(*keys, "n", "skewness", "kurtosis", "jb", F.col("p_value").alias("jb_p"))
    roots = unit_root(df, residual, order_by, keys, level, regression).drop("n")
    says = lambda p, yes, no: F.when(F.col(p).isNull() | F.isnan(p), "not computed").when(F.col(p) < level, yes).otherwise(no)
    out = normal.join(box, keys, "left").join(roots, keys, "left")
    return out.withColumn("autocorrelation", says("lb_p", "found", "not found")).withColumn("normality", says("jb_p", "rejected", "not rejected")).withColumn("stationarity", F.coalesce("verdict", F.lit("not computed"))).drop("verdict")


def average_rank(df: DataFrame, column: str, name: str, by: Sequence[str] = (), range_rows: int = RANGE_ROWS) -> DataFrame:
    """Ranks from 1, equal values share the mean of theirs; null and NaN values and keys have a rank too. Rows per value are counted first, and added up by ranges of values."""
    rows = df.withColumn("_value", F.struct(column, *by))
    counts = rows.groupBy("_value", F.col(column).alias("_v"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)]).agg(F.count(F.lit(1)).alias("_n"))
    upto = along(counts, [f"_k{i}" for i in range(len(by))], ["_v"], sums={"_upto": F.col("_n")}, range_rows=range_rows, rows=df.count())
    return rows.join(upto.select("_value", (F.col("_upto") - (F.col("_n") - 1) / 2.0).alias(name)), "_value").drop("_value")


def pair_correlation(df: DataFrame, x: str, y: str, by: Sequence[str] = (), range_rows: int = RANGE_ROWS) -> DataFrame:
    """``by, n, pearson, spearman`` over pairs of finite values; null with fewer than three or a constant side."""
    rows = df.filter(is_finite(x) & is_finite(y)).select(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    rows = average_rank(average_rank(rows, "_x", "_rx", by, range_rows), "_y", "_ry", by, range_rows)
    enough = F.count(F.lit(1)) >= 3
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.when(enough, correlation("_x", "_y")).alias("pearson"), F.when(enough, correlation("_rx", "_ry")).alias("spearman"))


def direction(r: Column, threshold: float = 0.05) -> Column:
    return F.when(r.isNull(), "undefined").when(r > threshold, "+").when(r < -threshold, "-").otherwise("none")


def influence(df: DataFrame, features: Sequence[str], residual: str) -> DataFrame:
    """``df`` with ``leverage, standardized_residual, cooks_distance`` of a linear fit with intercept.

    Values that are not finite are the median. Columns are standardised, their Gram matrix is one aggregate, and its pseudo-inverse (a matrix
    of the number of features) is applied to each row as an expression; collinear features are no problem. Rows with a residual that is not finite are left out; no more rows than
    rank is an error.
    """
    rows = df.filter(is_finite(residual))
    clean = {c: F.when(is_finite(c), F.col(c).cast("double")) for c in features}
    middle = quantiles(rows, clean, [0.5]).first()
    filled = {c: F.coalesce(x, F.lit(float(middle[c][0]) if middle[c] is not None else 0.0)) for c, x in clean.items()}
    scale = rows.agg(*[f(x).alias(f"{n}{i}") for i, x in enumerate(filled.values()) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    standard = [(x - F.lit(scale[f"m{i}"])) / F.lit(scale[f"s{i}"]) if scale[f"s{i}"] else F.lit(0.0) for i, x in enumerate(filled.values())]
    # a generator of one row keeps the expressions above from being copied into each place that uses them
    rows = rows.select("*", F.inline(F.array(F.struct(F.lit(1.0).alias("_z0"), *[x.alias(f"_z{i}") for i, x in enumerate(standard, 1)]))))
    p = len(features) + 1
    z = [F.col(f"_z{i}") for i in range(p)]
    sums = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.pow(F.col(residual), F.lit(2))).alias("sse"), *[F.sum(z[i] * z[j]).alias(f"g{i}_{j}") for i in range(p) for j in range(i, p)]).first()
    gram = np.array([[sums[f"g{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(p)] for i in range(p)])
    rank = int((np.linalg.eigvalsh(gram) > 1e-10 * max(gram.trace(), 1e-300)).sum())
    n = sums["n"]
    if n <= rank:
        raise ValueError(f"{n} rows are too few for rank {rank}")
    inverse = np.linalg.pinv(gram, rcond=1e-10, hermitian=True)
    h = F.lit(0.0)
    for i in range(p):
        h = h + z[i] * sum((F.lit(float(inverse[i, j])) * z[j] for j in range(p)), F.lit(0.0))
    mse = sums["sse"] / (n - rank)
    out = rows.select(*df.columns, F.inline(F.array(F.struct(F.least(h, F.lit(1.0)).alias("leverage")))))
    left = 1 - F.col("leverage")
    out = out.withColumn("standardized_residual", ratio(F.col(residual), F.sqrt(F.lit(mse) * left)))
    return out.withColumn("cooks_distance", ratio(F.pow("standardized_residual", F.lit(2)) * F.col("leverage"), left * rank))


def top_influence(df: DataFrame, k: int) -> DataFrame:
    return df.orderBy(F.desc_nulls_last("cooks_distance")).limit(k)


def above_threshold(df: DataFrame) -> DataFrame:
    """Rows whose distance is over 4 / n. The rows are counted first (a count reads no column), so that the filter is by a number."""
    return df.filter(F.col("cooks_distance") > 4.0 / max(1, df.count()))


def cook_contour(leverage: Column, distance: float, rank: int) -> Column:
    """The standardised residual that has this distance at a leverage."""
    return F.sqrt(F.lit(distance * rank) * (1 - leverage) / leverage)
