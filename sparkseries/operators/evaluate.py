"""The tables behind evaluation plots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import correlation, is_finite, normal_density, normal_quantile, ratio
from .base import as_list, ordered
from .correlogram import acf, band, direction, pacf, pair_correlation
from .profile import histogram
from .windows import blocks


def residual_summary(df: DataFrame, y: str, p: str, series: str) -> DataFrame:
    """``series`` (null: all), ``n, mean, std, skewness, kurtosis, mae, rmse`` of y - p over finite pairs, in one rollup."""
    rows = df.filter(is_finite(y) & is_finite(p)).select(series, (F.col(y) - F.col(p)).cast("double").alias("_e"))
    e = F.col("_e")
    return rows.rollup(series).agg(F.count(e).alias("n"), F.avg(e).alias("mean"), F.stddev_samp(e).alias("std"), F.skewness(e).alias("skewness"), F.kurtosis(e).alias("kurtosis"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))


def residual_histogram(df: DataFrame, residual: str, bins: int = 50) -> DataFrame:
    """Bins of the residuals with the normal density of their mean and deviation, as counts, at each middle."""
    rows = df.filter(is_finite(residual))
    one = rows.agg(F.avg(residual).alias("_m"), F.stddev_samp(residual).alias("_s"), F.count(F.lit(1)).alias("_n"))
    middle = (F.col("low") + F.col("high")) / 2
    out = histogram(rows, [residual], bins).crossJoin(F.broadcast(one))
    return out.select("bin", "low", "high", "n", (normal_density(middle, "_m", "_s") * F.col("_n") * (F.col("high") - F.col("low"))).alias("normal_n"))


def qq_points(df: DataFrame, residual: str, key: str, series: Sequence[str] = ()) -> DataFrame:
    """``series, key, theoretical, standardized``: ordered standardised residuals against normal quantiles at Filliben's medians."""
    keys = as_list(series)
    rows = df.filter(is_finite(residual)).select(*keys, key, F.col(residual).cast("double").alias("_e"))
    whole = Window.partitionBy(*keys)
    rows = rows.withColumn("_n", F.count(F.lit(1)).over(whole)).withColumn("_i", F.row_number().over(ordered(["_e", key], keys)))
    rows = rows.withColumn("_z", ratio(F.col("_e") - F.avg("_e").over(whole), F.stddev_samp("_e").over(whole)))
    end = F.pow(F.lit(0.5), 1 / F.col("_n"))
    p = F.when(F.col("_i") == 1, 1 - end).when(F.col("_i") == F.col("_n"), end).otherwise((F.col("_i") - 0.3175) / (F.col("_n") + 0.365))
    return rows.select(*keys, key, normal_quantile(p).alias("theoretical"), F.col("_z").alias("standardized"))


def qq_correlation(points: DataFrame, series: Sequence[str] = ()) -> DataFrame:
    return points.groupBy(*series).agg(correlation("theoretical", "standardized").alias("r"))


def residual_correlogram(df: DataFrame, residual: str, order_by, series, nlags: int = 40) -> DataFrame:
    """``series, n, lag, acf, pacf, band``: both correlograms of each series' residuals and half the width of their band; ``pacf`` is null from lag n / 2 on."""
    keys = as_list(series)
    partial = pacf(df, residual, order_by, keys, nlags).select(*keys, "lag", "pacf")
    return acf(df, residual, order_by, keys, nlags).join(partial, [*keys, "lag"], "left").select(*keys, "n", "lag", "acf", "pacf", band(F.col("n")).alias("band"))


def residual_bands(df: DataFrame, residual: str, time: str, series, fold: str) -> DataFrame:
    """``df`` with ``block`` (runs of one fold), ``rolling`` (mean of the last max(7, n // 20) residuals of the block, half of them at least), and ``low, high``: two deviations of the series."""
    keys = as_list(series)
    w = ordered(time, keys)
    rows = blocks(df, F.col("_changes"), time, keys) if "_changes" in df.columns else blocks(df.withColumn("_changes", F.col(fold) != F.lag(fold).over(w)), F.col("_changes"), time, keys).drop("_changes")
    size = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.stddev_samp(residual).alias("_s"), F.avg(residual).alias("_m"))
    rows = rows.join(size, keys) if keys else rows.crossJoin(F.broadcast(size))
    # in units of a series' own width one frame fits them all: rows less than one width back, less a margin for widths up to 9e8
    width, one = F.greatest(F.lit(7), F.floor(F.col("_n") / 20)), 10**12
    block = Window.partitionBy(*keys, "block")
    rows = rows.withColumn("_at", F.round(F.row_number().over(block.orderBy(time)) / width * one).cast("long"))
    last = block.orderBy("_at").rangeBetween(1000 - one, 0)
    rolling = F.when(F.count(residual).over(last) >= F.floor(width / 2), F.avg(residual).over(last))
    return rows.withColumns({"rolling": rolling, "low": F.col("_m") - 2 * F.col("_s"), "high": F.col("_m") + 2 * F.col("_s")}).drop("_n", "_s", "_m", "_at")


def importance(attributions: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``by, feature, importance``: the mean absolute attribution."""
    return attributions.select(*by, *[F.col(c).cast("double").alias(c) for c in features]).unpivot(list(by), list(features), "feature", "_a").groupBy(*by, "feature").agg(F.avg(F.abs("_a")).alias("importance"))


def top_features(attributions: DataFrame, features: Sequence[str], k: int) -> list[str]:
    return [r["feature"] for r in importance(attributions, features).orderBy(F.desc_nulls_last("importance"), "feature").limit(k).collect()]


def _value_pairs(df: DataFrame, features: Sequence[str], prefix: str) -> DataFrame:
    items = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x"), F.col(f"{prefix}{c}").cast("double").alias("a")) for c in features])
    return df.select(F.explode(items).alias("i")).select("i.*")


def attribution_correlation(df: DataFrame, features: Sequence[str], prefix: str = "attr_", threshold: float = 0.05) -> DataFrame:
    """``feature, n, pearson, spearman, direction`` of each feature's values and its attributions (columns with the prefix)."""
    pairs = _value_pairs(df, features, prefix)
    found = pair_correlation(pairs, "x", "a", ["feature"])
    every = df.sparkSession.createDataFrame([(c,) for c in features], "feature string").join(found, "feature", "left")
    return every.select("feature", F.coalesce("n", F.lit(0)).alias("n"), "pearson", "spearman", direction(F.col("spearman"), threshold).alias("direction"))


def dependence(df: DataFrame, features: Sequence[str], prefix: str = "attr_", bins: int = 20) -> DataFrame:
    """``feature, bin, n, mean_value, mean_attribution``: what a dependence plot shows, at any size."""
    pairs = _value_pairs(df, features, prefix).filter(is_finite("x") & is_finite("a"))
    ends = pairs.groupBy("feature").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    rows = pairs.join(F.broadcast(ends), "feature").withColumn("bin", F.coalesce(F.least(F.floor(F.try_divide((F.col("x") - F.col("lo")) * bins, F.col("hi") - F.col("lo"))), F.lit(bins - 1)), F.lit(0)).cast("long"))
    return rows.groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean_value"), F.avg("a").alias("mean_attribution"))
