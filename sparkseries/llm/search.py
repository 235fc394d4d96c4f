"""Exact top-k search by inner product: a table of pivot distances bounds every candidate, which are evaluated in bound order until none can win."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

#: Pivots; candidates in a block, about; candidates evaluated at a time; blocks, and queries, whose bounds are compared in one task.
PIVOTS, BLOCK_ROWS, CHUNK, CHUNK_BLOCKS, CHUNK_QUERIES = 64, 4096, 64, 2048, 20_000
#: Distances are rounded to single precision; bounds are taken lower by this share of the largest.
SLACK = 1e-6


def valid_vectors(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``id, v, norm2``: one row per id whose vector has only finite components, as doubles floor(256 x)."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    scaled = F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("double"))
    rows = vectors.filter(F.col(key).isNotNull() & F.col(vector).isNotNull() & finite).select(F.col(key).cast("long").alias("id"), scaled.alias("v"))
    return rows.groupBy("id").agg(F.min("v").alias("v")).withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))


def _lifted(vectors: np.ndarray, most: float) -> np.ndarray:
    """With one more component, so that all have the squared norm ``most`` and the nearest is that of the highest inner product."""
    return np.hstack([vectors, np.sqrt(np.maximum(0.0, most - (vectors**2).sum(1)))[:, None]])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T))


def _stack(arrays: pd.Series, kind: type = float) -> np.ndarray:
    return np.array(arrays.tolist(), dtype=kind).reshape(len(arrays), len(arrays.iloc[0]) if len(arrays) else 0)


def best_of(query_id: int, q: np.ndarray, from_pivots: np.ndarray, least: float, ids: np.ndarray, vectors: np.ndarray, to_pivots: np.ndarray, most: float, k: int) -> list[tuple[float, int]]:
    """(-score, id) of the query's best ``k`` candidates of at least the score ``least``.

    Distances are in the lifted space, where the squared distance is the query's squared norm + ``most`` - twice the
    inner product. A candidate is at least as far as its distance to any pivot differs from the query's.
    """
    norm2 = float(q @ q)
    bound = np.abs(to_pivots - from_pivots).max(axis=1)
    order = np.argsort(bound, kind="stable")
    slack = SLACK * (2 * math.sqrt(most) + math.sqrt(norm2) + 1)
    best: list[tuple[float, int]] = []
    for at in range(0, len(order), CHUNK):
        # equal scores are not cut off
        if least > -math.inf and bound[order[at]] > math.sqrt(max(0.0, norm2 + most - 2 * least)) + slack:
            break
        some = order[at : at + CHUNK]
        scores = vectors[some] @ q
        best += [(-s, i) for s, i in zip(scores.tolist(), ids[some].tolist(), strict=True) if i != query_id and s >= least]
        best = sorted(best)[:k]
        if len(best) == k:
            least = max(least, -best[-1][0])
    return best


def _distances_to(pivots: np.ndarray, most: float):
    """Rows (id, v) with their distances to the pivots and the nearest one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lifted = _lifted(pivots, most)
        for batch in batches:
            found = _distances(_lifted(_stack(batch["v"]), most), lifted) if len(batch) else np.zeros((0, len(pivots)))
            yield batch.assign(dist=list(found.astype(np.float32)), cell=found.argmin(axis=1).astype(np.int32))

    return run


def _ranges(group: pd.DataFrame) -> pd.DataFrame:
    """Of a block the least and largest distance to each pivot."""
    dist = _stack(group["dist"], np.float32)
    return pd.DataFrame({"block": [int(group["block"].iloc[0])], "low": [dist.min(axis=0)], "high": [dist.max(axis=0)]})


def _evaluate(most: float, k: int):
    """Blocks in order, each its candidates (``is_query`` false) and then the queries that come to it, to (query, candidate, score)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, held, arrays = None, [], None
        for batch in batches:
            rows: list[tuple[int, int, int]] = []
            for (b, is_query), part in batch.groupby(["block", "is_query"], sort=True):
                if b != block:
                    block, held, arrays = b, [], None
                if not is_query:
                    held.append(part)
                    continue
                if not held:
                    continue
                if arrays is None:
                    of = pd.concat(held)
                    arrays = of["id"].to_numpy(), _stack(of["v"]), _stack(of["dist"], np.float32)
                for query_id, v, dist, least in zip(part["id"].tolist(), part["v"], part["dist"], part["least"].tolist(), strict=True):
                    q = np.array(v, dtype=float)
                    rows += ((query_id, i, int(-s)) for s, i in best_of(query_id, q, np.array(dist, dtype=np.float32), least, *arrays, most, k))
            yield pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])

    return run


def _query_distances(pivots: np.ndarray, most: float):
    """Rows (id, v, block, is_query, least) with the distances as a query, whose lifted component is 0, to the pivots."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            q = _stack(batch["v"])
            dist = np.sqrt(np.maximum(0.0, (q**2).sum(1)[:, None] + most - 2 * q @ pivots.T)) if len(batch) else np.zeros((0, len(pivots)))
            yield batch.assign(dist=list(dist.astype(np.float32)))

    return run


def _may_win(most: float):
    """Chunks in order, each the ranges of its blocks (``is_query`` false) and then queries, to the queries once for each block that may hold one of their best."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunk, held, ranges = None, [], None
        for batch in batches:
            for (*at, is_query), part in batch.groupby(["chunk", "salt", "is_query"], sort=True):
                if at != chunk:
                    chunk, held, ranges = at, [], None
                if not is_query:
                    held.append(part)
                    continue
                if not held:
                    continue
                if ranges is None:
                    of = pd.concat(held)
                    ranges = of["block"].to_numpy(), _stack(of["low"], np.float32), _stack(of["high"], np.float32)
                blocks, low, high = ranges
                for k in range(len(part)):
                    dist, least = np.array(part["dist"].iloc[k], dtype=np.float32), float(part["least"].iloc[k])
                    norm2 = float((np.array(part["v"].iloc[k]) ** 2).sum())
                    bound = np.maximum(low - dist, dist - high).max(axis=1)
                    farthest = math.sqrt(max(0.0, norm2 + most - 2 * least)) if least > -math.inf else math.inf
                    wins = blocks[(bound <= farthest + SLACK * (2 * math.sqrt(most) + math.sqrt(norm2) + 1)) & (blocks != part["block"].iloc[k])]
                    for a in range(0, len(wins), 1024):
                        some = part.iloc[[k] * len(wins[a : a + 1024])]
                        yield some[["id", "v", "dist", "least", "is_query"]].assign(block=wins[a : a + 1024])

    return run


def _search(same: DataFrame, is_query: Column, k: int, most: float, n_pivots: int, block_rows: int) -> DataFrame:
    """``query_id, vec_id, score`` with the best of each query, among others, over vectors of one length."""
    chosen = same.orderBy(F.xxhash64("id"), "id").limit(n_pivots).collect()
    pivots = _stack(pd.Series([r["v"] for r in chosen], dtype=object))
    near = cut(same.select("id", "v").mapInPandas(_distances_to(pivots, most), "id long, v array<double>, dist array<float>, cell int"))
    # of each pivot's cell, its first block and how many it has
    first, places = 0, []
    for cell, size in sorted((r["cell"], r["n"]) for r in near.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()):
        places.append((cell, first, math.ceil(size / block_rows)))
        first += places[-1][2]
    of = lambda x: F.element_at(F.create_map(*[F.lit(v) for p in places for v in (p[0], p[x])]), F.col("cell"))
    pivot_table = cut(near.select("id", "v", "dist", (of(1) + F.pmod(F.xxhash64("id"), of(2).cast("long"))).cast("int").alias("block")))
    columns = ["block", "is_query", "id", "v", "dist", "least"]
    candidates = pivot_table.select("block", F.lit(False).alias("is_query"), "id", "v", "dist", F.lit(0.0).alias("least"))

    def evaluated(queries: DataFrame) -> DataFrame:
        # a block for each task; candidates travel once, and only queries more often
        met = candidates.unionByName(queries.select(columns)).repartition(max(first, 1), "block").sortWithinPartitions("block", "is_query")
        return cut(met.mapInPandas(_evaluate(most, k), "query_id long, vec_id long, score long"))

    schema = "block int, is_query boolean, id long, v array<double>, least double, dist array<float>"
    queries = cut(pivot_table.filter(is_query).select("block", F.lit(True).alias("is_query"), "id", "v", F.lit(-math.inf).alias("least")).mapInPandas(_query_distances(pivots, most), schema))
    own = evaluated(queries)
    known = own.groupBy("query_id").agg(F.min("score").alias("worst"), F.count(F.lit(1)).alias("found")).filter(F.col("found") >= k).select(F.col("query_id").alias("id"), F.col("worst").cast("double").alias("worst"))
    queries = queries.join(known, "id", "left").withColumn("least", F.coalesce("worst", "least")).drop("worst")

    chunks, salts = math.ceil(max(first, 1) / CHUNK_BLOCKS), max(1, math.ceil(queries.count() / CHUNK_QUERIES))
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    ranges = pivot_table.select("block", "dist").groupBy("block").applyInPandas(_ranges, "block int, low array<float>, high array<float>")
    none = F.lit(None).cast("array<float>")
    left = ranges.select((F.col("block") % chunks).cast("int").alias("chunk"), each(salts).alias("salt"), F.lit(False).alias("is_query"), "block", "low", "high", F.lit(0).cast("long").alias("id"), F.lit(None).cast("array<double>").alias("v"), none.alias("dist"), F.lit(0.0).alias("least"))
    right = queries.select(each(chunks).alias("chunk"), F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt"), "is_query", "block", none.alias("low"), none.alias("high"), "id", "v", "dist", "least")
    compared = left.unionByName(right).repartition("chunk", "salt").sortWithinPartitions("chunk", "salt", "is_query")
    further = evaluated(compared.mapInPandas(_may_win(most), "id long, v array<double>, dist array<float>, least double, is_query boolean, block int"))
    return own.unionByName(further)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, *, key: str = "vec_id", vector: str = "embedding", n_pivots: int = PIVOTS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` highest integer inner products of each query with the other rows, ties to the smaller id.

    ``is_query`` is a condition on the column ``id``. The distances of all rows to ``n_pivots`` rows chosen by hash, which are all that
    goes through the driver, are written once. Rows are in blocks of about ``block_rows`` around the same pivot. Each query is
    first held against its own block, which gives it a score to beat; then it goes to those blocks whose range of distances to the
    pivots allows a better score. Candidates stay where their block is.

    Null ids, null vectors and vectors with a null or non-finite component take no part. Rows that share an id are one (the
    smallest vector). Vectors of different lengths are not compared; only lengths that occur are searched. With fewer
    than ``k`` others all are returned; an empty table gives no rows. Other columns are ignored.
    """
    rows = cut(valid_vectors(vectors, key, vector).withColumn("d", F.size("v")))
    out = rows.sparkSession.createDataFrame([], "query_id long, vec_id long, score long")
    for d, most in [tuple(r) for r in rows.groupBy("d").agg(F.max("norm2")).orderBy("d").collect()]:
        out = out.unionByName(_search(rows.filter(F.col("d") == d), is_query, k, most, n_pivots, block_rows))
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, 5)


OP9_SQL = """
WITH v AS (
  SELECT vec_id, min(list_transform(embedding, lambda x: floor(256 * x::DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  GROUP BY vec_id),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
