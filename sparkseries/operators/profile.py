"""Profiles of tables and columns, histograms, correlations, calendars."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations, combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import correlation, is_finite, ratio
from .base import as_list
from .quantiles import EXACT_ROWS, quantiles
from .reshape import time_column


def table_profile(df: DataFrame, name: str = "") -> DataFrame:
    """One row: rows, columns, duplicated rows and their rate, columns and cells with missing values and their rate. Two aggregates."""
    nulls = [F.count_if(F.col(f"`{c}`").isNull()) for c in df.columns]
    cells, columns = F.lit(0).cast("long"), F.lit(0).cast("long")
    for n in nulls:
        cells, columns = cells + n, columns + (n > 0).cast("long")
    one = df.agg(F.count(F.lit(1)).alias("n_rows"), columns.alias("missing_columns"), cells.alias("missing_cells"))
    distinct = df.distinct().agg(F.count(F.lit(1)).alias("_d"))
    rows = one.crossJoin(distinct)
    k = len(df.columns)
    return rows.select(F.lit(name).alias("name"), "n_rows", F.lit(k).cast("long").alias("n_columns"), (F.col("n_rows") - F.col("_d")).alias("duplicated_rows"), ratio(F.col("n_rows") - F.col("_d"), "n_rows").alias("duplicated_rate"), "missing_columns", "missing_cells", ratio("missing_cells", F.col("n_rows") * k).alias("missing_rate"))


_STATS = ("mean", "std", "min", "p25", "median", "p75", "max", "skewness")


def column_profile(df: DataFrame, exact_rows: int = EXACT_ROWS) -> DataFrame:
    """One row per column: ``column, dtype, missing, missing_rate, n_unique`` (null counts as a value), ``unique_rate, mode, mode_rate``, and for numbers
    ``mean, std, min, p25, median, p75, max, skewness`` (sample deviation, linear quantiles, population skewness).

    The statistics of all columns are one aggregate, but for the quantiles (``quantiles``); the values of all columns are counted in one unpivoted pass, ties of the mode go
    to the first value in order of its text.
    """
    parts, wanted, kinds = [], {}, dict(df.dtypes)
    numeric = {f.name for f in df.schema if isinstance(f.dataType, T.NumericType)}
    for i, c in enumerate(df.columns):
        x = F.col(f"`{c}`")
        parts.append(F.count_if(x.isNull()).alias(f"n{i}"))
        if c in numeric:
            v = F.nanvl(x.cast("double"), F.lit(None).cast("double"))
            wanted[f"q{i}"] = v
            parts.append(F.array(F.avg(v), F.stddev_samp(v), F.min(v), F.max(v), F.skewness(v)).alias(f"t{i}"))
    one = df.agg(F.count(F.lit(1)).alias("n_rows"), *parts)
    if wanted:
        # one row each
        one = one.crossJoin(quantiles(df, wanted, [0.25, 0.5, 0.75], exact_rows=exact_rows))
    joined = lambda i: F.concat(F.slice(f"t{i}", 1, 3), F.coalesce(F.col(f"q{i}"), F.array(*[F.lit(None).cast("double")] * 3)), F.slice(f"t{i}", 4, 2))
    one = one.withColumns({f"s{i}": joined(i) if f"q{i}" in wanted else F.lit(None).cast("array<double>") for i in range(len(df.columns))})
    items = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("dtype"), F.col(f"n{i}").alias("missing"), F.col(f"s{i}").alias("s")) for i, c in enumerate(df.columns)])
    stats = one.select("n_rows", F.explode(items).alias("x")).select("n_rows", "x.*")
    values = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns]).unpivot([], df.columns, "column", "v")
    counts = values.groupBy("column", "v").agg(F.count(F.lit(1)).alias("n"))
    modes = counts.groupBy("column").agg(F.count(F.lit(1)).alias("n_unique"), F.min(F.when(F.col("v").isNotNull(), F.struct(-F.col("n"), "v"))).alias("m"), F.sum(F.when(F.col("v").isNotNull(), F.col("n"))).alias("present"))
    out = stats.join(modes, "column", "left")
    top = -F.col("m").getField("col1")
    return out.select("column", "dtype", "missing", ratio("missing", "n_rows").alias("missing_rate"), F.coalesce("n_unique", F.lit(0)).alias("n_unique"), ratio("n_unique", "n_rows").alias("unique_rate"), F.col("m.v").alias("mode"), ratio(top, "present").alias("mode_rate"), *[F.get("s", F.lit(k)).alias(n) for k, n in enumerate(_STATS)])


def missing_ranking(df: DataFrame) -> DataFrame:
    """``column, missing_rate``, the highest first."""
    one = df.agg(*[F.avg(F.col(f"`{c}`").isNull().cast("double")).alias(c) for c in df.columns])
    return one.unpivot([], df.columns, "column", "missing_rate").orderBy(F.desc("missing_rate"), "column")


def histogram(df: DataFrame, columns: Sequence[str], bins: int = 50) -> DataFrame:
    """``column, bin, low, high, n`` of equal bins between the least and the greatest finite value, the last one closed. Empty bins have no row."""
    long = df.select(*[F.when(is_finite(c), F.col(c).cast("double")).alias(c) for c in columns]).unpivot([], list(columns), "column", "v").filter(F.col("v").isNotNull())
    ends = long.groupBy("column").agg(F.min("v").alias("a"), F.max("v").alias("b"))
    width = (F.col("b") - F.col("a")) / bins
    rows = long.join(F.broadcast(ends), "column").withColumn("bin", F.coalesce(F.least(F.floor(F.try_divide(F.col("v") - F.col("a"), width)), F.lit(bins - 1)), F.lit(0)).cast("long"))
    out = rows.groupBy("column", "bin", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    return out.select("column", "bin", (F.col("a") + F.col("bin") * width).alias("low"), (F.col("a") + (F.col("bin") + 1) * width).alias("high"), "n")


def top_values(df: DataFrame, n: int = 15, most_unique: float = 0.5) -> DataFrame:
    """``column, value, n, rank`` of the most frequent values of text and boolean columns, but for those with more than that share of unique values."""
    columns = [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.BooleanType))]
    counts = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "column", "value").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy("column").agg(F.count(F.lit(1)).alias("_u"), F.sum("n").alias("_r"))
    kept = counts.join(F.broadcast(sizes.filter(F.col("_u") <= most_unique * F.col("_r")).select("column")), "column").filter(F.col("value").isNotNull())
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value")))
    return ranked.filter(F.col("rank") <= n).select("column", "value", "n", F.col("rank").cast("long").alias("rank"))


def _pairs(parts: Mapping[tuple[str, str], Column], df: DataFrame, extra: Column | None = None) -> DataFrame:
    names = list(parts)
    one = df.agg(*([extra.alias("n")] if extra is not None else []), *[parts[p].alias(f"r{k}") for k, p in enumerate(names)])
    items = F.array(*[F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.col(f"r{k}").alias("r")) for k, (a, b) in enumerate(names)])
    return one.select(*(["n"] if extra is not None else []), F.explode(items).alias("x"))


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column_a, column_b, r, rows, excluded`` over rows in which all columns are set; nothing with under two columns or rows. One aggregate."""
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([], "column_a string, column_b string, r double, rows long, excluded long")
    full = F.lit(True)
    for c in columns:
        full = full & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    x = {c: F.when(full, F.col(c).cast("double")) for c in columns}
    pairs = {(a, b): correlation(x[a], x[b]) for a, b in combinations_with_replacement(columns, 2)}
    out = _pairs(pairs, df, F.struct(F.count_if(full).alias("rows"), F.count_if(~full).alias("excluded")))
    upper = out.filter(F.col("n.rows") >= 2).select("x.column_a", "x.column_b", "x.r", "n.rows", "n.excluded")
    return upper.unionByName(upper.filter(F.col("column_a") != F.col("column_b")).select(F.col("column_b").alias("column_a"), F.col("column_a").alias("column_b"), "r", "rows", "excluded"))


def pairwise_correlation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column_a, column_b, r`` of each unordered pair over the rows in which both are finite."""
    x = {c: F.when(is_finite(c), F.col(c).cast("double")) for c in columns}
    return _pairs({(a, b): correlation(x[a], x[b]) for a, b in combinations(columns, 2)}, df).select("x.column_a", "x.column_b", "x.r")


def pair_counts(df: DataFrame, columns: Sequence[str], bins: int = 20) -> DataFrame:
    """Counts of both columns' bins for each unordered pair: what a scatter matrix shows, at any size."""
    ends = df.agg(*[f(F.when(is_finite(c), F.col(c).cast("double"))).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("a", F.min), ("b", F.max))])
    rows = df.select(*columns).crossJoin(F.broadcast(ends))
    bin_of = lambda i, c: F.when(is_finite(c), F.coalesce(F.least(F.floor(F.try_divide((F.col(c) - F.col(f"a{i}")) * bins, F.col(f"b{i}") - F.col(f"a{i}"))), F.lit(bins - 1)), F.lit(0)).cast("long"))
    binned = rows.select(*[bin_of(i, c).alias(f"x{i}") for i, c in enumerate(columns)])
    items = F.array(*[F.struct(F.lit(columns[i]).alias("column_a"), F.lit(columns[j]).alias("column_b"), F.col(f"x{i}").alias("bin_a"), F.col(f"x{j}").alias("bin_b")) for i, j in combinations(range(len(columns)), 2)])
    cells = binned.select(F.explode(items).alias("p")).select("p.*").filter(F.col("bin_a").isNotNull() & F.col("bin_b").isNotNull())
    return cells.groupBy("column_a", "column_b", "bin_a", "bin_b").agg(F.count(F.lit(1)).alias("n"))


def calendar_summary(df: DataFrame, time: str) -> DataFrame:
    """One row: ``first, last, n_rows, expected_days, missing_days, duplicated_rows`` (all rows of days with more than one)."""
    days = df.filter(F.col(time).isNotNull()).groupBy(F.col(time).cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    expected = F.datediff(F.max("day"), F.min("day")) + 1
    return days.agg(F.min("day").alias("first"), F.max("day").alias("last"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), expected.cast("long").alias("expected_days"), (expected - F.count(F.lit(1))).cast("long").alias("missing_days"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicated_rows"))


def yearly_means(df: DataFrame, time: str, ranges: Mapping[str, tuple[float, float]]) -> DataFrame:
    """``year, n_days`` and each variable's mean over its values within bounds."""
    means = [F.avg(F.when(F.col(c).between(lo, hi), F.col(c).cast("double"))).alias(c) for c, (lo, hi) in ranges.items()]
    return df.groupBy(F.year(time).cast("long").alias("year")).agg(F.count(F.lit(1)).alias("n_days"), *means)


def monthly_boxes(df: DataFrame, time: str, value: str, low: float | None = None, high: float | None = None, exact_rows: int = EXACT_ROWS) -> DataFrame:
    """``month, n, excluded, q1, median, q3, whisker_low, whisker_high, outliers``: whiskers at the last values within 1.5 times the quartile distance."""
    inside = F.lit(True)
    if low is not None:
        inside = inside & (F.col(value) >= low)
    if high is not None:
        inside = inside & (F.col(value) <= high)
    rows = df.select(F.month(time).cast("long").alias("month"), F.when(inside, F.col(value).cast("double")).alias("v"))
    of_month = quantiles(rows, {"q": F.col("v")}, [0.25, 0.5, 0.75], ["month"], exact_rows).withColumnRenamed("month", "_month")
    counts = rows.groupBy("month").agg(F.count("v").alias("n"), F.count_if(F.col("v").isNull()).alias("excluded"))
    quartiles = counts.join(of_month, F.col("month").eqNullSafe(F.col("_month"))).select("month", "n", "excluded", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    span = 1.5 * (F.col("q3") - F.col("q1"))
    within = F.col("v").between(F.col("q1") - span, F.col("q3") + span)
    by = rows.join(F.broadcast(quartiles), "month").groupBy("month", "n", "excluded", "q1", "median", "q3")
    return by.agg(F.min(F.when(within, F.col("v"))).alias("whisker_low"), F.max(F.when(within, F.col("v"))).alias("whisker_high"), F.count_if(~within).alias("outliers"))


def bounds(df: DataFrame, time: str, value: str) -> DataFrame:
    """First and last time; least and greatest finite value."""
    v = F.when(is_finite(value), F.col(value).cast("double"))
    return df.agg(F.min(time).alias("first"), F.max(time).alias("last"), F.min(v).alias("low"), F.max(v).alias("high"))


def grouping_column(df: DataFrame, most: int = 500, time: str | None = None) -> DataFrame:
    """``column, n_values, is_group``: the columns with at most ``most`` values, and whether time and that column together are unique. The values of all columns are counted in one unpivoted pass."""
    time = time or time_column(df)
    if time is None:
        return df.sparkSession.createDataFrame([], "column string, n_values long, is_group boolean")
    columns = [f.name for f in df.schema if f.name != time and not isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, n_values long, is_group boolean")
    values = df.select(F.col(time).alias("_t"), *[F.col(f"`{c}`").cast("string").alias(c) for c in columns]).unpivot(["_t"], columns, "column", "_v")
    # in steps, so that no row is copied for each distinct count; null is a value, and a time
    pairs = values.groupBy("column", "_v", "_t").agg(F.count(F.lit(1)).alias("_n")).groupBy("column", "_v").agg(F.count(F.lit(1)).alias("_pairs"), F.sum("_n").alias("_n"))
    found = pairs.groupBy("column").agg(F.count(F.lit(1)).alias("n_values"), (F.sum("_pairs") == F.sum("_n")).alias("is_group"))
    return found.filter(F.col("n_values") <= most)


def group_values(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("value")).distinct().orderBy("value")


def daily_max(df: DataFrame, time: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*as_list(by), F.col(time).cast("date").alias("day")).agg(F.max(value).alias("max_value"))
