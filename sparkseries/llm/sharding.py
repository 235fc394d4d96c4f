"""Sharding by longest-processing-time scheduling of groups that must stay together."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, dense_rank_in, join_checked, table


def lpt(sizes: list[int], loads: list[float]) -> list[int]:
    """The bin of each size, in the given order: always the least loaded one, ties to the lower number. ``loads`` is not changed."""
    heap = [(load, k) for k, load in enumerate(loads)]
    heapq.heapify(heap)
    out = []
    for size in sizes:
        load, k = heap[0]
        heapq.heapreplace(heap, (load + size, k))
        out.append(k)
    return out


def _schedule(loads: list[float]):
    """Largest first within each part, through a heap that starts at the part's share of what the giants have put on the shards."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, heap = None, []
        for batch in batches:
            shards = []
            for p, size in zip(batch["part"].tolist(), batch["bytes"].tolist(), strict=True):
                if p != part:
                    part = p
                    heap = [(load, (k + p) % len(loads), k) for k, load in enumerate(loads)]
                    heapq.heapify(heap)
                load, turn, k = heap[0]
                heapq.heapreplace(heap, (load + size, turn, k))
                shards.append(k)
            yield batch[["g", "size", "text_crc32"]].assign(shard=pd.Series(shards, dtype="int32"))

    return run


def shard_documents(docs: DataFrame, n_shards: int = 40, *, key: str = "doc_id", text: str = "text", overhead: int = 16, part_groups: int = 20_000, max_parts: int = 4096, max_giants: int = 100_000) -> DataFrame:
    """Put documents into ``n_shards`` shards of nearly equal bytes; rows with equal texts share a shard.

    Returns ``key, size, text_crc32, shard, slot``. A group is all rows with one text and weighs the
    sum of their sizes (UTF-8 bytes plus ``overhead``). Groups above a share of the total, at most
    ``max_giants`` of them by construction, are scheduled first, largest first, on one heap. The
    rest is dealt by hash into parts; each part is sorted by size and scheduled on its own heap,
    which starts at the part's share of the giants' loads, so the parts' shards add up to equal
    shards. A group of any number of rows is one entry of a heap; its rows are never gathered.

    Null texts count as empty but are a group of their own; null keys are kept; repeated rows are
    separate rows of one group and get separate slots; ties go to the lower shard (giants) or to the
    shard whose turn it is (parts). An empty table gives no rows. Other columns, whatever their
    names, are ignored.
    """
    body = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    rows = cut(docs.select(F.col(key).alias(key), (F.octet_length(body) + overhead).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.xxhash64(F.col(text).isNull(), text).alias("g")))
    same = ["g", "size", "text_crc32"]
    groups = cut(rows.groupBy(*same).agg(F.count(F.lit(1)).alias("n")).withColumn("bytes", F.col("n") * F.col("size")))
    total, n_groups, n_rows = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    parts = min(max_parts, max(1, math.ceil(n_groups / part_groups)))
    least = max(1, total // min(max_giants, n_shards * parts * 20))

    # at most total / least groups, that is max_giants, can be this large
    giants = groups.filter(F.col("bytes") >= least).select(*same, "bytes").orderBy(F.desc("bytes"), *same).collect()
    placed, loads = lpt([r["bytes"] for r in giants], [0.0] * n_shards), [0.0] * n_shards
    for r, k in zip(giants, placed, strict=True):
        loads[k] += r["bytes"]
    schema = "g long, size long, text_crc32 long, shard int"
    large = docs.sparkSession.createDataFrame([(r["g"], r["size"], r["text_crc32"], k) for r, k in zip(giants, placed, strict=True)], schema)

    start = [x / parts for x in loads]
    small = groups.filter(F.col("bytes") < least).select(*same, "bytes", F.pmod(F.xxhash64("g", "text_crc32"), F.lit(parts)).alias("part"))
    small = small.repartition(parts, "part").sortWithinPartitions("part", F.desc("bytes"), *same).mapInPandas(_schedule(start), schema)

    with_large = join_checked(rows, large.withColumnRenamed("shard", "_giant"), same, "left", rows=len(giants))
    rest = with_large.filter(F.col("_giant").isNull()).drop("_giant").join(small, same)
    placed_rows = cut(with_large.filter(F.col("_giant").isNotNull()).select(key, *same, F.col("_giant").alias("shard")).unionByName(rest.select(key, *same, "shard")))
    buckets = max(8, math.ceil(n_rows / (n_shards * 100_000)))
    ranked = dense_rank_in(placed_rows, ["shard"], [key, "g"], F.pmod(F.xxhash64(key, "g"), F.lit(buckets)), "slot")
    return ranked.select(key, "size", "text_crc32", "shard", "slot")


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(table(spark, sf_dir, "documents"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
