"""Cross-validation folds as columns or as (fold, role) rows; nothing is shuffled by a random generator, only by hashes of keys."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import as_list
from .ranges import RANGE_ROWS, along, written

KINDS = ("kfold", "stratified", "group", "stratified_group", "time_series", "sliding_window", "time_cutoff")
TIME_KINDS = ("time_series", "sliding_window", "time_cutoff")


def check_config(kind: str, task: str, *, group: str | None = None, n_splits: int = 5, max_train_size: int | None = None, cutoffs: Sequence | None = None) -> None:
    """Reject combinations that cannot be right."""
    if kind not in KINDS:
        raise ValueError(f"{kind} is none of {KINDS}")
    if kind != "time_cutoff" and n_splits < 2:
        raise ValueError("two folds at least")
    if task == "time_series" and kind not in TIME_KINDS:
        raise ValueError(f"time series need one of {TIME_KINDS}")
    if kind in ("group", "stratified_group") and not group:
        raise ValueError(f"{kind} needs a group column")
    if kind.startswith("stratified") and task not in ("binary", "multiclass"):
        raise ValueError("only classes can be stratified")
    if kind == "sliding_window" and not max_train_size:
        raise ValueError("a sliding window needs its size")
    if kind == "time_cutoff" and not cutoffs:
        raise ValueError("cutoffs are needed")


def _order(key: str, shuffle: bool, seed: int) -> list[Column]:
    return [F.xxhash64(F.col(key), F.lit(seed)), F.col(key)] if shuffle else [F.col(key)]


def kfold(df: DataFrame, key: str, n_splits: int = 5, shuffle: bool = False, seed: int = 0, name: str = "fold") -> DataFrame:
    """Folds of nearly equal size.

    Shuffled: a hash of the key decides, row by row, without a shuffle of data; sizes are equal up to chance. Otherwise: contiguous in the
    order of the key, exactly, by ranges of the key found with one count per range, so no window holds the table.
    """
    if n_splits < 2:
        raise ValueError("two folds at least")
    if shuffle:
        return df.withColumn(name, F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(n_splits)).cast("int"))
    rows = global_index(df, [key], "_i")
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    return rows.crossJoin(F.broadcast(total)).withColumn(name, F.floor(F.col("_i") * n_splits / F.col("_n")).cast("int")).drop("_i", "_n")


def global_index(df: DataFrame, order: Sequence[str], name: str, parts: int | None = None) -> DataFrame:
    """The place of each row in the order, from 0: rows are dealt into ranges (``parts`` of them, or of RANGE_ROWS rows), numbered in each, and moved up by the counts of the ranges before."""
    rows = df.count()
    size = RANGE_ROWS if parts is None else max(1, -(-rows // parts))
    return along(df, [], order, place="_place", range_rows=size, rows=rows).withColumn(name, F.col("_place") - 1).drop("_place")


def _index_within(df: DataFrame, by: str, order: Sequence[str], name: str) -> DataFrame:
    """The place of each row in the order of the rows with its value of ``by``, from 0; one hot value is dealt into ranges like many."""
    return along(df, [by], order, place="_place").withColumn(name, F.col("_place") - 1).drop("_place")


def stratified(df: DataFrame, key: str, label: str, n_splits: int = 5, shuffle: bool = False, seed: int = 0, name: str = "fold") -> DataFrame:
    """Every fold has the classes in their proportions: rows of a class take turns. No window holds a class, however large; classes are few."""
    rows = df.withColumn("_h", F.xxhash64(F.col(key), F.lit(seed)) if shuffle else F.lit(0).cast("long"))
    return _index_within(rows, label, ["_h", key], "_at").withColumn(name, F.pmod("_at", F.lit(n_splits)).cast("int")).drop("_h", "_at")


def group_fold(df: DataFrame, group: str, n_splits: int = 5, name: str = "fold") -> DataFrame:
    """A group is in one fold. Groups by size take turns back and forth, so folds are nearly equal; only the table of groups is ordered, by ranges."""
    sizes = df.groupBy(group).agg((-F.count(F.lit(1))).alias("_n"))
    turn = global_index(sizes, ["_n", group], "_at").withColumn("_k", F.col("_at") % n_splits).withColumn("_r", F.floor(F.col("_at") / n_splits) % 2)
    folds = turn.select(group, F.when(F.col("_r") == 0, F.col("_k")).otherwise(n_splits - 1 - F.col("_k")).cast("int").alias(name))
    return df.join(folds, group)


def stratified_group(df: DataFrame, group: str, label: str, n_splits: int = 5, name: str = "fold") -> DataFrame:
    """Groups stay whole and classes are spread: groups of one leading class take turns by size."""
    counts = df.groupBy(group, label).agg(F.count(F.lit(1)).alias("_n"))
    of_group = counts.groupBy(group).agg(F.sum("_n").alias("_n"), F.max_by(label, F.struct("_n", label)).alias("_top"))
    turns = _index_within(of_group.withColumn("_n", -F.col("_n")), "_top", ["_n", group], "_turn")
    # each class begins where its number says, so that small classes do not all begin with fold 0
    classes = of_group.select(F.col("_top").alias("_class")).distinct().withColumn("_start", F.row_number().over(Window.orderBy("_class")) - 1)
    folds = turns.join(classes, F.col("_top").eqNullSafe(F.col("_class"))).select(group, F.pmod(F.col("_turn") + F.col("_start"), F.lit(n_splits)).cast("int").alias(name))
    return df.join(folds, group)


def greedy_folds(counts: np.ndarray, n_splits: int) -> list[int]:
    """A fold for each group of ``counts`` (groups x classes): those whose classes are most uneven first, each to the fold after which the shares of the classes differ least between folds; ties go to the fold of fewest rows."""
    total = np.maximum(counts.sum(axis=0), 1)
    loads = np.zeros((n_splits, counts.shape[1]))
    folds = [0] * len(counts)
    for g in np.argsort(-counts.std(axis=1), kind="stable"):
        tried = np.repeat(loads[None], n_splits, axis=0)
        tried[np.arange(n_splits), np.arange(n_splits)] += counts[g]
        spread = np.round((tried / total).std(axis=1).mean(axis=1), 12)
        best = min(range(n_splits), key=lambda k: (spread[k], loads[k].sum(), k))
        loads[best] += counts[g]
        folds[g] = best
    return folds


def balanced_group(df: DataFrame, group: str, label: str, n_splits: int = 5, name: str = "fold", part_groups: int = 20_000) -> DataFrame:
    """Groups stay whole, and every class of mixed groups is spread evenly over the folds (``greedy_folds``).

    Groups are counted by class in one aggregate; they are dealt by hash into parts of about ``part_groups``, each of which is balanced by itself, so no task holds all groups, and sums of
    balanced parts are balanced. Classes are few (at most 1000); a null class is one, rows of a null group are one group. An empty table gives no rows.
    """
    keyed = df.select(F.struct(group).alias("_g"), F.col(label).cast("string").alias("_c"))
    counts = written(keyed.groupBy("_g", "_c").agg(F.count(F.lit(1)).alias("_n")))
    classes = [r[0] for r in counts.select("_c").distinct().orderBy("_c").limit(1001).collect()]
    if len(classes) > 1000:
        raise ValueError("more than 1000 classes")
    of_class = [F.sum(F.when(F.col("_c").eqNullSafe(F.lit(c)), F.col("_n")).otherwise(0)) for c in classes] or [F.lit(0)]
    groups = counts.groupBy("_g").agg(F.array(*of_class).alias("_counts"))
    parts = max(1, -(-counts.count() // part_groups))
    # by the text of a group, so that ties are decided alike in every run
    order = F.coalesce(F.col(f"_g.`{group}`").cast("string"), F.lit(""))
    dealt = groups.select(F.pmod(F.xxhash64("_g"), F.lit(parts)).cast("int").alias("_part"), "_g", order.alias("_order"), "_counts")
    kind = counts.schema["_g"].dataType.simpleString()

    def assign(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_order", kind="stable")
        return part[["_g"]].assign(**{name: greedy_folds(np.array(part["_counts"].tolist(), float), n_splits)})

    folds = dealt.groupBy("_part").applyInPandas(assign, f"_g {kind}, `{name}` int")
    return df.drop(name).withColumn("_g", F.struct(group)).join(folds, "_g").select(*[c for c in df.columns if c != name], name)


def _expanding(df: DataFrame, time: str | Sequence[str], n_splits: int, gap: int, test_size: int | None, most: int | None) -> DataFrame:
    order = as_list(time)
    n = df.count()
    size = test_size or n // (n_splits + 1)
    first = n - n_splits * size
    if size < 1 or first - gap <= 0:
        raise ValueError(f"{n} rows are too few for {n_splits} folds of {size} with gap {gap}")
    ranges = [(k, max(0, first + k * size - gap - most) if most else 0, first + k * size - gap, first + k * size, first + (k + 1) * size) for k in range(n_splits)]
    table = df.sparkSession.createDataFrame(ranges, "fold int, _a long, _b long, _c long, _d long")
    rows = global_index(df, order, "_i").join(F.broadcast(table), ((F.col("_i") >= F.col("_a")) & (F.col("_i") < F.col("_b"))) | ((F.col("_i") >= F.col("_c")) & (F.col("_i") < F.col("_d"))))
    return rows.withColumn("role", F.when(F.col("_i") < F.col("_b"), "train").otherwise("valid")).drop("_i", "_a", "_b", "_c", "_d")


def time_series_split(df: DataFrame, time: str | Sequence[str], n_splits: int = 5, gap: int = 0, test_size: int | None = None) -> DataFrame:
    """A row per row and fold it takes part in: ``fold, role``. Training is all rows before, less the gap."""
    return _expanding(df, time, n_splits, gap, test_size, None)


def sliding_window_split(df: DataFrame, time: str | Sequence[str], max_train_size: int, n_splits: int = 5, gap: int = 0, test_size: int | None = None) -> DataFrame:
    """The same with at most ``max_train_size`` training rows, the latest."""
    return _expanding(df, time, n_splits, gap, test_size, max_train_size)


def time_cutoff_split(df: DataFrame, time: str, cutoffs: Sequence, valid_end=None) -> DataFrame:
    """Fold i trains on times before cutoff i and validates from there to the next (the last to ``valid_end``, or without end). Null times are in neither."""
    if list(cutoffs) != sorted(set(cutoffs)) or (valid_end is not None and valid_end <= cutoffs[-1]):
        raise ValueError("cutoffs must ascend")
    kind = df.schema[time].dataType
    spans = [(i, str(c), str(n) if n is not None else None) for i, (c, n) in enumerate(zip(cutoffs, [*cutoffs[1:], valid_end], strict=True))]
    table = df.sparkSession.createDataFrame(spans, "fold int, _c string, _d string").withColumns({c: F.col(c).cast(kind) for c in ("_c", "_d")})
    rows = df.join(F.broadcast(table), (F.col(time) < F.col("_c")) | ((F.col(time) >= F.col("_c")) & (F.col("_d").isNull() | (F.col(time) < F.col("_d")))))
    return rows.withColumn("role", F.when(F.col(time) < F.col("_c"), "train").otherwise("valid")).drop("_c", "_d")


def check_sides(split: DataFrame, n_splits: int) -> None:
    """An error if a fold has an empty side."""
    found = {(r["fold"], r["role"]) for r in split.groupBy("fold", "role").count().collect()}
    missing = [(k, role) for k in range(n_splits) for role in ("train", "valid") if (k, role) not in found]
    if missing:
        raise ValueError(f"empty: {missing}")


def fold_ids(df: DataFrame, split: DataFrame, key: str) -> DataFrame:
    """``df`` with the fold in which each row is validated, -1 if in none."""
    valid = split.filter(F.col("role") == "valid").groupBy(key).agg(F.max("fold").alias("fold"))
    return df.join(valid, key, "left").withColumn("fold", F.coalesce("fold", F.lit(-1)))


def most_recent(df: DataFrame, time: str | Sequence[str], share: float) -> DataFrame:
    """The latest share of the rows."""
    n = df.count()
    return global_index(df, as_list(time), "_i").filter(F.col("_i") >= n - int(share * n)).drop("_i")
