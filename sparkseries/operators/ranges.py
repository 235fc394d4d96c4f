"""Work along an order without one task for each series or for the table.

Rows are dealt into ranges of about RANGE_ROWS by the order (series first), windows run inside a range, and what a range leaves to the ranges after or before it - sums, the last and
the first value - is passed on through a table with one row for each series and range. A table of one range or less is not dealt out.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows in a range, about; rows that are equal in all columns of the order are in one range.
RANGE_ROWS = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share; a folder of our own only in local mode, where none is set."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("sparkseries.tables", "")
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-tables-")
        spark.conf.set("sparkseries.tables", folder)
    return folder.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder.

    A lost executor costs a read, and what is read twice is worked out once. The folder is the session's to clear.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_ranges(df: DataFrame, order: Sequence[Column], range_rows: int = RANGE_ROWS, rows: int | None = None) -> tuple[DataFrame, bool]:
    """``df`` with ``_range``, which grows along the order, and whether there is more than one range. ``rows`` is a bound on the number of rows, if one is known."""
    n = df.count() if rows is None else rows
    parts = -(-n // range_rows)
    if parts <= 1:
        return df.withColumn("_range", F.lit(0)), False
    return written(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id())), True


def along(
    df: DataFrame,
    series: Sequence[str],
    order: Sequence[str],
    *,
    place: str | None = None,
    sums: Mapping[str, Column] | None = None,
    totals: Mapping[str, Column] | None = None,
    last: Mapping[str, Column] | None = None,
    following: Mapping[str, Column] | None = None,
    previous: Mapping[str, Column] | None = None,
    descending: bool = False,
    range_rows: int = RANGE_ROWS,
    rows: int | None = None,
) -> DataFrame:
    """``df`` with columns that look along the order of each series, however long it is; without series the table is one.

    ``place``: the name for the row's number in its series, from 1, which the other columns may use; ``sums``: of the rows up to and with this one; ``totals``: of all rows of the series; ``last``: the last
    value that is not null up to this row; ``following``: the first from this row on; ``previous``: the value of the row before. Null counts as 0 in sums, and a series may have null keys. Rows that are equal in the order come in
    any order, but for all columns in the same. New names must not be those of columns that the expressions use.
    """
    sums, totals, last, following, previous = (dict(m or {}) for m in (sums, totals, last, following, previous))
    keys = list(series)
    direction = F.desc if descending else F.asc
    held, several = in_ranges(df, [*map(F.col, keys), *map(direction, order)], range_rows, rows)
    # one column for the series: equal also where a key is null, so that joins and windows share a partitioning
    by = ["_series", "_range"] if keys else ["_range"]
    if keys:
        held = held.withColumn("_series", F.struct(*keys))
    of_range, of_series = Window.partitionBy(*by), Window.partitionBy(*by[:-1])
    up = of_range.orderBy(*map(direction, order))
    upto = up.rowsBetween(Window.unboundedPreceding, 0)
    earlier = of_series.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = held.withColumn("_at", F.row_number().over(up).cast("long"))
    if place:
        if several:
            counts = held.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"))
            out = out.join(counts.select(*by, zero(F.sum("_rows").over(earlier)).alias("_rows")), by).withColumn(place, F.col("_at") + F.col("_rows"))
        else:
            out = out.withColumn(place, F.col("_at"))
    out = out.withColumns({n: zero(F.sum(zero(c)).over(upto)) for n, c in sums.items()} | {n: F.last(c, ignorenulls=True).over(upto) for n, c in last.items()} | {n: F.lag(c).over(up) for n, c in previous.items()})
    # in the opposite order of the same numbers: a frame that shrinks row by row would take quadratic time
    down = of_range.orderBy(F.desc("_at")).rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumns({n: F.last(c, ignorenulls=True).over(down) for n, c in following.items()})
    names = [n for m in ({place: None} if place else {}, sums, totals, last, following, previous) for n in m]
    if several and (sums or totals or last or following or previous):
        with_place = lambda c: F.when(c.isNotNull(), F.col("_at"))
        edges = out.groupBy(*by).agg(
            *[F.sum(zero(c)).alias(f"_s_{n}") for n, c in (sums | totals).items()],
            *[F.max_by(c, with_place(c)).alias(f"_l_{n}") for n, c in last.items()],
            *[F.min_by(c, with_place(c)).alias(f"_f_{n}") for n, c in following.items()],
            *[F.max_by(F.struct(c.alias("v")), "_at").alias(f"_p_{n}") for n, c in previous.items()],
        )
        # one row for each series and range
        later = of_series.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
        passed = edges.select(
            *by,
            *[zero(F.sum(f"_s_{n}").over(earlier)).alias(f"_s_{n}") for n in sums],
            *[F.sum(f"_s_{n}").over(of_series).alias(f"_t_{n}") for n in totals],
            *[F.last(f"_l_{n}", ignorenulls=True).over(earlier).alias(f"_l_{n}") for n in last],
            *[F.last(f"_f_{n}", ignorenulls=True).over(later).alias(f"_f_{n}") for n in following],
            *[F.lag(f"_p_{n}").over(of_series.orderBy("_range")).alias(f"_p_{n}") for n in previous],
        )
        out = out.join(passed, by).withColumns(
            {n: F.col(n) + F.col(f"_s_{n}") for n in sums}
            | {n: F.col(f"_t_{n}") for n in totals}
            | {n: F.coalesce(n, f"_l_{n}") for n in last}
            | {n: F.coalesce(n, f"_f_{n}") for n in following}
            | {n: F.when(F.col("_at") > 1, F.col(n)).otherwise(F.col(f"_p_{n}.v")) for n in previous}
        )
    elif totals:
        out = out.withColumns({n: zero(F.sum(zero(c)).over(of_range)) for n, c in totals.items()})
    return out.select(*[c for c in df.columns if c not in names], *names)


def with_past(df: DataFrame, series: Sequence[str], order: Sequence[str], lookback: int, range_rows: int = RANGE_ROWS) -> tuple[DataFrame, list[str], str, Column]:
    """Rows for windows that look back at most ``lookback`` rows: rows, keys to partition by, column to order by, and the condition of the rows to keep afterwards.

    Each series is cut into chunks of about ``range_rows``, and each chunk also has the last ``lookback`` rows of the one before.
    """
    keys, n = list(series), df.count()
    size = max(range_rows, lookback, 1)  # so that the rows looked back at are in one chunk
    if n <= size:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn("_chunk", F.lit(0).cast("long")).withColumn("_i", F.row_number().over(w).cast("long")), [*keys, "_chunk"], "_i", F.lit(True)
    rows = along(df, keys, order, place="_i", range_rows=range_rows, rows=n).withColumn("_own", F.floor((F.col("_i") - 1) / size).cast("long"))
    also = F.when(F.col("_i") > (F.col("_own") + 1) * size - lookback, F.array(F.col("_own"), F.col("_own") + 1)).otherwise(F.array(F.col("_own")))
    return rows.withColumn("_chunk", F.explode(also)), [*keys, "_chunk"], "_i", F.col("_chunk") == F.col("_own")
