"""Windows over one long series without putting it into one task.

A window without a partition key gathers the whole table. Here rows get their global numbers by ranges (``folds.global_index``), are cut into
chunks of equal length, and each chunk also gets the last rows of the one before as context. Windows then run per chunk; running sums and
products add or multiply what the chunks before come to.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import global_index

CHUNK_ROWS = 1_000_000


def by_chunks(df: DataFrame, order_by: Sequence[str], lookback: int, transform: Callable[[DataFrame, str, str], DataFrame], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``transform(rows, order, series)`` applied as if to one series, for windows that look back at most ``lookback`` rows.

    ``transform`` gets the names of the columns to order by and to partition by; it must keep both.
    """
    size = max(chunk_rows, lookback, 1)
    rows = global_index(df, list(order_by), "_i").withColumn("_own", F.floor(F.col("_i") / size).cast("long"))
    also = F.when(F.col("_i") >= (F.col("_own") + 1) * size - lookback, F.array(F.col("_own"), F.col("_own") + 1)).otherwise(F.array(F.col("_own")))
    out = transform(rows.withColumn("_chunk", F.explode(also)), "_i", "_chunk")
    return out.filter(F.col("_chunk") == F.col("_own")).drop("_i", "_own", "_chunk")


def _running(df: DataFrame, order_by: Sequence[str], local: Callable[[Column], Column], value: Column, join: Callable[[Column, Column], Column], neutral: float, name: str, chunk_rows: int) -> DataFrame:
    rows = global_index(df, list(order_by), "_i").withColumn("_chunk", F.floor(F.col("_i") / chunk_rows).cast("long"))
    totals = rows.groupBy("_chunk").agg(local(value).alias("_t"))
    before = totals.select("_chunk", F.coalesce(local(F.col("_t")).over(Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(neutral)).alias("_before"))
    inside = local(value).over(Window.partitionBy("_chunk").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_in", inside).join(F.broadcast(before), "_chunk").withColumn(name, join(F.col("_before"), F.col("_in"))).drop("_i", "_chunk", "_in", "_before")


def running_sum(df: DataFrame, order_by: Sequence[str], value: str, name: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The sum up to each row; nulls count as 0. The table of chunk totals has one row per ``chunk_rows`` rows."""
    return _running(df, order_by, F.sum, F.coalesce(F.col(value).cast("double"), F.lit(0.0)), lambda a, b: a + b, 0.0, name, chunk_rows)


def running_product(df: DataFrame, order_by: Sequence[str], value: str, name: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The product up to each row; nulls count as 1."""
    return _running(df, order_by, F.product, F.coalesce(F.col(value).cast("double"), F.lit(1.0)), lambda a, b: a * b, 1.0, name, chunk_rows)
