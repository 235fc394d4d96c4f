"""What the training-data operators share: reading, cutting lineage, size-checked joins, distributed ranks."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words of a text are the runs of bytes other than blank, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"

#: A side of a join is broadcast only if it has been counted and has no more rows, and no more bytes as stored, than this.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 4_000_000


#: Rows of whole texts that go to a Python worker at a time.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a folder of our own in local mode (tests), else an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.conf.get("sparkseries.scratch", "")
        if not found:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            found = "file://" + tempfile.mkdtemp(prefix="spark-scratch-")
            spark.conf.set("sparkseries.scratch", found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The lineage ends there: a lost executor costs a re-read, not a re-run of what came before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_short_batches(df: DataFrame) -> DataFrame:
    """``df``, of which Python workers get BATCH_ROWS rows at a time: rows are whole texts, and a worker and its JVM hold some batches each. A number that the session has been given stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if df.sparkSession.conf.get(name) == "10000":
        df.sparkSession.conf.set(name, str(BATCH_ROWS))
    return df


def tidy_worker(run: Callable[[Iterable], Iterator], forget: Callable[[], None] | None = None) -> Callable[[Iterable], Iterator]:
    """``run``, after which the worker, which other tasks use again, forgets its tables and gives free memory back to the system.

    ``forget`` is a function of a module, as the worker's own tables are meant, not copies that travel with the task.
    """

    def wrapped(batches: Iterable) -> Iterator:
        try:
            yield from run(batches)
        finally:
            if forget:
                forget()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # other systems have no such call
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return wrapped


def is_small(df: DataFrame, rows: int | None = None) -> bool:
    """Whether a table that has been cut before may be broadcast: by its rows, and by the bytes that Spark knows of its files."""
    if (df.count() if rows is None else rows) > BROADCAST_ROWS:
        return False
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= BROADCAST_BYTES


def join_checked(df: DataFrame, small: DataFrame, on: list[str], how: str = "inner", rows: int | None = None) -> DataFrame:
    """Join with a table that has been cut before: broadcast if it ``is_small``, else a shuffle join (AQE splits hot keys)."""
    return df.join(F.broadcast(small) if is_small(small, rows) else small, on, how)


def dense_rank_in(df: DataFrame, group: list[str], order: list[str], bucket: Column, name: str) -> DataFrame:
    """Add ``name``: 0, 1, 2, ... without gaps within each ``group``, in no particular order across buckets.

    No window holds a whole group: rows are numbered within (group, bucket) and moved up by the
    counts of the buckets before. ``df`` is read twice, so it should have been cut.
    """
    keyed = df.withColumn("_bucket", bucket)
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = keyed.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n")).select(*group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = keyed.withColumn("_rn", F.row_number().over(Window.partitionBy(*group, "_bucket").orderBy(*order)))
    return numbered.join(offsets, [*group, "_bucket"]).withColumn(name, (F.col("_rn") - 1 + F.col("_before")).cast("long")).drop("_bucket", "_rn", "_before")
