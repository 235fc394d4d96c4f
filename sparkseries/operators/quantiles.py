"""Exact quantiles of many columns and groups without gathering a column into one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import INF
from .ranges import written

#: Rows of a table whose values one aggregate may hold; steps of the sketches that narrow more values down, and their accuracy.
EXACT_ROWS, STEPS, ACCURACY = 500_000, 1000, 10_000


def _narrowed(left: DataFrame, numbers: DataFrame, margin: int) -> DataFrame:
    """``left`` with closer limits: from sketches of the values between the old ones, with the values below, at and between them counted. A rank at a limit has its value."""
    span, at = ["_g", "c", "low", "high"], margin
    between = (F.col("v") > F.col("low")) & (F.col("v") < F.col("high"))
    inside = numbers.join(left.select(*span).distinct(), ["_g", "c"]).filter(between)
    sketches = inside.groupBy(*span).agg(F.min("v").alias("least"), F.max("v").alias("most"), F.percentile_approx("v", [k / STEPS for k in range(STEPS + 1)], ACCURACY).alias("e"))
    place = (F.col("k") - F.col("below")) / F.greatest(F.col("between") - 1, F.lit(1)) * STEPS
    i, j = F.floor(place) - at, F.ceil(place) + at
    lo, hi = F.when(i > 0, F.get("e", i.cast("int"))).otherwise(F.col("least")), F.when(j < STEPS, F.get("e", j.cast("int"))).otherwise(F.col("most"))
    closer = written(left.join(sketches, span).select("_g", "c", "k", "low", "high", "below", "between", lo.alias("lo"), hi.alias("hi")))
    v, counts = F.col("v"), {"b": F.col("v") < F.col("lo"), "l": F.col("v") == F.col("lo"), "m": (F.col("v") > F.col("lo")) & (F.col("v") < F.col("hi")), "h": (F.col("v") == F.col("hi")) & (F.col("lo") < F.col("hi"))}
    counted = numbers.join(closer, ["_g", "c"]).filter(between).groupBy("_g", "c", "k").agg(*[F.count_if(c & v.isNotNull()).alias(n) for n, c in counts.items()])
    both = closer.join(counted, ["_g", "c", "k"])
    k, first = F.col("k"), F.col("below") + F.col("b")
    value = F.when((k >= first) & (k < first + F.col("l")), F.col("lo")).when((k >= first + F.col("l") + F.col("m")) & (k < first + F.col("l") + F.col("m") + F.col("h")), F.col("hi"))
    # limits that don't hold the rank, against the sketch's bound, are not taken
    holds = (k >= first + F.col("l")) & (k < first + F.col("l") + F.col("m"))
    new = lambda a, b: F.when(holds, b).otherwise(F.col(a)).alias(a)
    return both.select("_g", "c", "k", new("low", F.col("lo")), new("high", F.col("hi")), new("below", first + F.col("l")), new("between", F.col("m")), value.alias("value"))


def quantiles(df: DataFrame, columns: Mapping[str, Column], shares: Sequence[float], by: Sequence[str] = (), exact_rows: int = EXACT_ROWS) -> DataFrame:
    """``by``, and for each name an array of the exact quantiles at ``shares``, interpolated linearly between neighbours in rank, as ``percentile`` gives; one row without ``by``.

    Nulls are left out; NaN is greater than any number; a group without values has null. As ``percentile`` keeps all distinct values of a group in one
    reducer, tables of more than ``exact_rows`` rows are narrowed first: a sketch of bounded size gives limits between which a
    wanted rank lies, one aggregate counts the values below and between them, and the next round looks at those between
    only, until they are few. Each round leaves about 1 in STEPS / 6 of the values, whatever their distribution and however many are equal.
    """
    keys, shares = list(by), [float(p) for p in shares]
    if df.count() <= exact_rows:
        grouped = df.groupBy(*keys) if keys else df.groupBy()
        return grouped.agg(*[F.percentile(x.cast("double"), F.array(*map(F.lit, shares))).alias(n) for n, x in columns.items()])
    group = F.struct(F.lit(0), *keys).alias("_g")
    held = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), x.cast("double").alias("v")) for i, x in enumerate(columns.values())]))
    long = df.select(group, held.alias("_x")).select("_g", "_x.c", "_x.v").filter(F.col("v").isNotNull())
    # n values, of which m are numbers, the rest NaN above them
    every = written(long.groupBy("_g", "c").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.isnan("v")).alias("m"), F.count_if(F.col("v") == F.lit(-INF)).alias("lows"), F.count_if(F.col("v") == F.lit(INF)).alias("highs")))
    at = lambda p: (F.col("n") - 1) * F.lit(p)
    ranks = every.withColumn("k", F.explode(F.array_distinct(F.array(*[f(at(p)).cast("long") for p in shares for f in (F.floor, F.ceil)]))))
    outer = F.when(F.col("k") >= F.col("m"), F.lit(float("nan"))).when(F.col("k") < F.col("lows"), F.lit(-INF)).when(F.col("k") >= F.col("m") - F.col("highs"), F.lit(INF))
    found = written(ranks.select("_g", "c", "k", F.lit(-INF).alias("low"), F.lit(INF).alias("high"), F.col("lows").alias("below"), (F.col("m") - F.col("lows") - F.col("highs")).alias("between"), outer.alias("value")))
    numbers, margin, widest = long.filter(~F.isnan("v")), 2, None
    while (now := found.filter(F.col("value").isNull()).agg(F.max("between")).first()[0]) is not None and now > max(1, exact_rows):
        margin, widest = min(STEPS, margin * 2) if now == widest else margin, now
        found = written(found.filter(F.col("value").isNotNull()).unionByName(_narrowed(found.filter(F.col("value").isNull()), numbers, margin)))
    left = found.filter(F.col("value").isNull())
    span = ["_g", "c", "low", "high"]
    inside = numbers.join(left.select(*span).distinct(), ["_g", "c"]).filter((F.col("v") > F.col("low")) & (F.col("v") < F.col("high")))
    last = left.drop("value").join(inside.groupBy(*span).agg(F.array_sort(F.collect_list("v")).alias("vs")), span)
    values = found.filter(F.col("value").isNotNull()).select("_g", "c", "k", "value").unionByName(last.select("_g", "c", "k", F.get("vs", (F.col("k") - F.col("below")).cast("int")).alias("value")))
    of_column = values.groupBy("_g", "c").agg(F.map_from_entries(F.collect_list(F.struct("k", "value"))).alias("v")).join(every, ["_g", "c"])

    def interpolated(p: float) -> Column:
        below, above = F.floor(at(p)).cast("long"), F.ceil(at(p)).cast("long")
        a, b = F.element_at("v", below), F.element_at("v", above)
        return F.when(a == b, a).otherwise((above - at(p)) * a + (at(p) - below) * b)

    wide = of_column.select("_g", "c", F.array(*map(interpolated, shares)).alias("q")).groupBy("_g").agg(*[F.any_value(F.when(F.col("c") == i, F.col("q")), ignoreNulls=True).alias(n) for i, n in enumerate(columns)])
    return df.select(group).distinct().join(wide, "_g", "left").select(*[F.col(f"_g.`{k}`") for k in keys], *columns)
