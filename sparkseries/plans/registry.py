"""Queries by name, each beside the SQL that it equals, if SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import rounded

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, whole numbers as long, dates as text: the same types and values as the SQL side."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        out.append((rounded(c, digits) if kind in ("double", "float") else c.cast("long") if kind in ("int", "smallint", "tinyint") else c.cast("string") if kind == "date" else c).alias(name))
    return df.select(*out)


#: The daily series that many queries start from, and the same in SQL.
DAILY_SQL = "daily AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders GROUP BY 1)"
BY_PRIORITY_SQL = "panel AS (SELECT o_orderpriority AS series, strftime(o_orderdate, '%Y-%m-%d') AS day, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2)"


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.count(F.lit(1)).alias("n"))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("series"), F.col("o_orderdate").cast("date").alias("day")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
