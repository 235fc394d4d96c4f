"""Hard negatives by exact inner products: components of many candidates packed into one wide integer, which is multiplied once for each component of an anchor."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

#: Production parameters: positives of an anchor, negatives of a positive, percent of the positive's score that a negative's has at least and at most.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95
#: Candidates in a block, anchors in a chunk (both about), and groups of labels that have blocks of their own.
BLOCK_ROWS, CHUNK_ROWS, LABEL_GROUPS = 8192, 1024, 64


def labelled_vectors(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """``id, label, v``: one row per id with a label and only finite components, as longs floor(256 x)."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & finite)
    scaled = F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("long"))
    one = rows.groupBy(F.col(key).cast("long").alias("id")).agg(F.min(F.struct(F.col(label).alias("label"), scaled.alias("v"))).alias("s"))
    return one.select("id", "s.label", "s.v")


def field_bits(length: int, most: int) -> int:
    """Bits of a field that holds any inner product of two vectors of ``length`` components from -most to most, biased to be positive: 32 or 64."""
    bits = (2 * length * most * 2 * most + 1).bit_length()
    if bits > 63:
        raise ValueError(f"inner products of {length} components up to {most} don't fit a long")
    return 32 if bits <= 32 else 64


def pack(vectors: np.ndarray, bias: int, bits: int) -> list[bytes]:
    """For each component an integer, as bytes, with one field of ``bits`` for each vector: its component plus ``bias``, which makes it positive."""
    return [c.tobytes() for c in np.ascontiguousarray((vectors + bias).T.astype(f"<u{bits // 8}"))]


def unpack(packed: list[int], anchor: list[int], bias: int, most: int, n: int, bits: int) -> np.ndarray:
    """Inner products of the anchor with the ``n`` packed vectors.

    Each packed component is multiplied by the anchor's; the fields of the sum are the products plus ``bias`` times the sum of
    the anchor's components. What negative components take away is added to all fields first, so that no field borrows from the next.
    """
    lift = 2 * most * sum(abs(a) for a in anchor)
    ones = ((1 << bits * n) - 1) // ((1 << bits) - 1)
    total = ones * lift
    for p, a in zip(packed, anchor, strict=False):
        if a:
            total += p * a
    fields = np.frombuffer(total.to_bytes(n * bits // 8, "little"), f"<u{bits // 8}").astype(np.int64)
    return fields - (lift + bias * sum(anchor[: len(packed)]))


def _packed_block(most: int, bits: int):
    def of_block(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("id")
        width = max(map(len, block["v"]), default=0)
        full = np.zeros((len(block), width), np.int64)
        for row, v in zip(full, block["v"], strict=True):
            row[: len(v)] = v
        return pd.DataFrame({"block": [key[0]], "label_group": block["label_group"].iloc[:1].tolist(), "n": [len(block)], "ids": [block["id"].to_numpy(np.int64).tobytes()], "labels": [block["label"].to_numpy(np.int64).tobytes()], "packed": [pack(full, most, bits)]})

    return of_block


class _Products:
    """The inner products of one block with anchors, one anchor at a time."""

    def __init__(self, block: pd.Series, most: int, bits: int):
        self.n, self.most, self.bits = int(block["n"]), most, bits
        self.ids, self.labels = np.frombuffer(block["ids"], np.int64), np.frombuffer(block["labels"], np.int64)
        self.packed = [int.from_bytes(p, "little") for p in block["packed"]]

    def of(self, anchor: np.ndarray) -> np.ndarray:
        return unpack(self.packed, anchor.tolist(), self.most, self.most, self.n, self.bits)


def _best(scores: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Of the places ``at``, which are in the order of ids, the ``k`` of the highest scores, ties to the smaller id."""
    if len(at) > k:
        least = np.partition(scores[at], len(at) - k)[len(at) - k]
        at = at[scores[at] >= least]
    return at[np.argsort(-scores[at], kind="stable")][:k]


def _positives(k: int, most: int, bits: int):
    def of_pair(blocks: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        for _, block in blocks.iterrows():
            products = _Products(block, most, bits)
            for anchor, label, v in zip(anchors["id"], anchors["label"], anchors["v"], strict=True):
                at = np.flatnonzero((products.labels == label) & (products.ids != anchor))
                if len(at):
                    scores = products.of(v)
                    best = _best(scores, at, k)
                    found += [(anchor, i, s) for i, s in zip(products.ids[best].tolist(), scores[best].tolist(), strict=True)]
        return pd.DataFrame(found, columns=["anchor_id", "positive_id", "positive_score"])

    return of_pair


def _negatives(k: int, low: int, high: int, most: int, bits: int):
    def of_pair(blocks: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        for _, block in blocks.iterrows():
            products = _Products(block, most, bits)
            for anchor, label, v, positives in zip(anchors["id"], anchors["label"], anchors["v"], anchors["positives"], strict=True):
                other = np.flatnonzero(products.labels != label)
                if not len(other):
                    continue
                scores = products.of(v)
                of_score: dict[int, list[tuple]] = {}
                for p in positives:
                    score = p["positive_score"]
                    if score not in of_score:
                        # low * score <= 100 * negative <= high * score, in whole numbers
                        least, top = -(-low * score // 100), high * score // 100
                        best = _best(scores, other[(scores[other] >= least) & (scores[other] <= top)], k)
                        of_score[score] = list(zip(products.ids[best].tolist(), scores[best].tolist(), strict=True))
                    found += [(anchor, p["positive_id"], score, i, s) for i, s in of_score[score]]
        return pd.DataFrame(found, columns=["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    return of_pair


def _ranked(df: DataFrame, group: list[str], score: str, key: str, k: int) -> DataFrame:
    order = Window.partitionBy(*group).orderBy(F.desc(score), key)
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, *, key: str = "vec_id", vector: str = "embedding", label: str = "label", n_positives: int = POSITIVES, n_negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block_rows: int = BLOCK_ROWS, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: rows of other labels whose inner product with an anchor is nearly that of the anchor's positives.

    Components become floor(256 x). ``is_anchor`` is a condition on the column ``id``. An anchor's positives are the ``n_positives`` other rows of its label with the highest
    inner products with it; the negatives of a positive are the ``n_negatives`` rows of other labels with the highest products among those from ``low`` to ``high`` percent
    of the positive's. Ties go to the smaller id; with fewer, all are returned.

    Candidates are in blocks of about ``block_rows``, packed once: for each component one wide integer with a field for each candidate, its component biased to be positive. Multiplying it by an anchor's component
    multiplies all; the sum over components is unpacked into exact products. Anchors in chunks of about ``chunk_rows`` go to the blocks: for positives to those of the
    anchor's group of labels only, for negatives to all. A block and a chunk are one task's work, however many rows a label has. Each pair of these gives
    at most ``n_negatives`` rows for each positive, which are then ranked.

    Rows with a null id, label or vector, or a null or non-finite component, take no part. Rows that share an id are one (the smallest label, then vector). Shorter vectors are
    taken to go on with zeros. Products that don't fit a long raise an error. An empty table gives no rows. Other columns are ignored.
    """
    group = F.pmod(F.xxhash64("label"), F.lit(LABEL_GROUPS)).cast("int")
    rows = cut(labelled_vectors(vectors, key, vector, label).select("id", F.col("label").cast("long").alias("label"), "v", group.alias("label_group"), is_anchor.alias("is_anchor")))
    spark = rows.sparkSession
    # at most LABEL_GROUPS rows
    sizes = rows.groupBy("label_group").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_anchor").alias("anchors"), F.max(F.size("v")).alias("length"), F.max(F.array_max(F.transform("v", F.abs))).alias("most")).orderBy("label_group").collect()
    if not any(r.anchors for r in sizes):
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    most = max(1, *(r.most or 0 for r in sizes))
    bits = field_bits(max(1, *(r.length for r in sizes)), most)

    def dealt(counts: dict[int, int], per: int) -> tuple[Column, int, dict[int, list[int]]]:
        """Number of the part of a row, parts in all, and the numbers of each group's parts."""
        parts = {g: max(1, -(-n // per)) for g, n in counts.items()}
        first, total = {}, 0
        for g, n in parts.items():
            first[g], total = total, total + n
        of_group = lambda values: F.element_at(F.create_map(*[F.lit(x) for g in parts for x in (g, values[g])]), F.col("label_group"))
        return (of_group(first) + F.pmod(F.xxhash64("id", F.lit(1)), of_group(parts))).cast("int"), total, {g: list(range(first[g], first[g] + parts[g])) for g in parts}

    block, n_blocks, blocks_of = dealt({r.label_group: r.n for r in sizes}, block_rows)
    chunk, n_chunks, chunks_of = dealt({r.label_group: r.anchors for r in sizes if r.anchors}, chunk_rows)
    blocks = cut(rows.withColumn("block", block).groupBy("block").applyInPandas(_packed_block(most, bits), "block int, label_group int, n int, ids binary, labels binary, packed array<binary>"))
    anchors = rows.filter("is_anchor").withColumn("chunk", chunk)

    each = lambda numbers: F.explode(numbers)
    of_group = lambda lists: F.element_at(F.create_map(*[x for g, numbers in lists.items() for x in (F.lit(g), F.array(*map(F.lit, numbers)))]), F.col("label_group"))
    left = blocks.filter(F.col("label_group").isin(list(chunks_of))).withColumn("chunk", each(of_group(chunks_of)))
    right = anchors.withColumn("block", each(of_group(blocks_of)))
    near = left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInPandas(_positives(n_positives, most, bits), "anchor_id long, positive_id long, positive_score long")
    positives = cut(_ranked(near, ["anchor_id"], "positive_score", "positive_id", n_positives))
    listed = positives.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))

    every = lambda n: each(F.sequence(F.lit(0), F.lit(n - 1)))
    left = blocks.withColumn("chunk", every(n_chunks))
    right = anchors.join(listed, "id").withColumn("block", every(n_blocks))
    hard = left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInPandas(_negatives(n_negatives, low, high, most, bits), "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    return _ranked(hard, ["anchor_id", "positive_id"], "negative_score", "negative_id", n_negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    # labels of some rows are wrong on purpose
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved), F.col("id") % 50 == 0)


OP12_SQL = f"""
WITH e AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.id AS a, c.id AS c, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score
  FROM e a JOIN e c ON a.id <> c.id WHERE a.id % 50 = 0),
p AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, c) AS rn FROM s WHERE same) x WHERE rn <= {POSITIVES}),
n AS (
  SELECT p.a, p.c AS positive, p.score AS positive_score, s.c AS negative, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.a, p.c ORDER BY s.score DESC, s.c) AS rank
  FROM p JOIN s ON p.a = s.a AND NOT s.same AND {LOW} * p.score <= 100 * s.score AND 100 * s.score <= {HIGH} * p.score)
SELECT a AS anchor_id, positive AS positive_id, rank::INTEGER AS rank, negative AS negative_id, positive_score, negative_score
FROM n WHERE rank <= {NEGATIVES}
"""
