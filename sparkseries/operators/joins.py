"""Joins with the checks that tell what they did."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of more than one row, ``n`` of them: a left join with this table would multiply rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def left_join_checked(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A left join that keeps the number of rows; repeated keys on the right are an error."""
    some = repeated_keys(right, keys).limit(5).collect()
    if some:
        raise ValueError(f"keys that are not unique: {[tuple(r)[: len(keys)] for r in some]}")
    return left.join(right, list(keys), "left")


def master_join(left: DataFrame, master: DataFrame, left_key: str, master_key: str) -> DataFrame:
    """A left join to a master table by keys of different names; rows without a match keep nulls. Of rows of one master key the first in order of the other columns counts."""
    others = [c for c in master.columns if c != master_key]
    first = F.min(F.struct(*others)).alias("_m") if others else F.lit(None).alias("_m")
    clean = master.filter(F.col(master_key).isNotNull()).groupBy(master_key).agg(first).select(master_key, *[F.col(f"_m.`{c}`") for c in others])
    return left.join(clean, left[left_key] == clean[master_key], "left").drop(clean[master_key])


def match_rate(joined: DataFrame, marker: str) -> DataFrame:
    """``rows, matched, unmatched, rate`` by whether ``marker``, a column of the right side, is set."""
    hit = F.count(marker)
    n = F.count(F.lit(1))
    return joined.agg(n.alias("rows"), hit.alias("matched"), (n - hit).alias("unmatched"), F.try_divide(hit.cast("double"), n).alias("rate"))


def overlapping_series(history: DataFrame, future: DataFrame, time: str, series: str | Sequence[str]) -> DataFrame:
    """Series (by all their keys) whose future does not begin after their history: ``series, last, first``."""
    keys = [series] if isinstance(series, str) else list(series)
    last = history.groupBy(*keys).agg(F.max(time).alias("last"))
    first = future.groupBy(*keys).agg(F.min(time).alias("first"))
    if not keys:
        return last.crossJoin(first).filter(F.col("first") <= F.col("last"))
    return last.join(first, keys).filter(F.col("first") <= F.col("last"))


def missing_days(df: DataFrame, time: str) -> DataFrame:
    """Days between the first and the last that have no row."""
    days = df.select(F.col(time).cast("date").alias("day")).distinct()
    ends = days.agg(F.min("day").alias("a"), F.max("day").alias("b")).filter(F.col("a").isNotNull())
    return ends.select(F.explode(F.sequence("a", "b")).alias("day")).join(days, "day", "left_anti")


def member_mismatches(members: dict[str, DataFrame], key: str = "key", target: str = "target", fold: str = "fold") -> DataFrame:
    """Rows on which members' predictions disagree, counted by reason: ``member, reason, n``. The first member is the measure."""
    (first, base), *rest = members.items()
    out = None
    a = base.select(F.col(key).alias("k"), F.col(target).alias("t"), F.col(fold).alias("f"))
    for name, df in rest:
        b = df.select(F.col(key).alias("k2"), F.col(target).alias("t2"), F.col(fold).alias("f2"))
        both = a.join(b, a["k"] == b["k2"], "full")
        reason = F.when(F.col("k").isNull() | F.col("k2").isNull(), "rows").when(~F.col("t").eqNullSafe(F.col("t2")), "target").when(~F.col("f").eqNullSafe(F.col("f2")), "fold")
        part = both.select(F.lit(name).alias("member"), reason.alias("reason")).filter(F.col("reason").isNotNull()).groupBy("member", "reason").agg(F.count(F.lit(1)).alias("n"))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else base.sparkSession.createDataFrame([], "member string, reason string, n long")
