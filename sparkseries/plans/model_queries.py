"""Folds, metrics, evaluation tables, models, forecasts and ensembles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs
from ..operators import correlogram, ensembles, evaluate, folds, forecasts, metrics, models, ridge, selection, windows
from ..operators.ranges import written
from .registry import BY_PRIORITY_SQL, DAILY_SQL, daily, events, panel, query, read, tidy

# -- folds -------------------------------------------------------------------------------------------------------



def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate")


@query("SELECT o_orderkey, ((row_number() OVER (ORDER BY o_orderkey) - 1) * 5 // count(*) OVER ())::BIGINT AS fold FROM orders")
def kfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(folds.kfold(_orders(spark, sf_dir), "o_orderkey", 5).select("o_orderkey", "fold"))


@query("SELECT o_orderkey, (row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1) % 5 AS fold FROM orders")
def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(folds.stratified(_orders(spark, sf_dir), "o_orderkey", "o_orderpriority", 5).select("o_orderkey", "fold"))


@query("""WITH c AS (SELECT o_custkey, row_number() OVER (ORDER BY count(*) DESC, o_custkey) - 1 AS k FROM orders GROUP BY 1)
SELECT o_orderkey, CASE WHEN k // 5 % 2 = 0 THEN k % 5 ELSE 4 - k % 5 END AS fold FROM orders JOIN c ON orders.o_custkey = c.o_custkey""")
def group_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(folds.group_fold(_orders(spark, sf_dir), "o_custkey", 5).select("o_orderkey", "fold"))


@query("""WITH n AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2), g AS (SELECT o_custkey, sum(n) AS n, max_by(o_orderpriority, (n, o_orderpriority)) AS top FROM n GROUP BY 1),
t AS (SELECT o_custkey, (row_number() OVER (PARTITION BY top ORDER BY n DESC, o_custkey) - 1 + dense_rank() OVER (ORDER BY top) - 1) % 5 AS fold FROM g) SELECT o_orderkey, fold FROM orders JOIN t ON orders.o_custkey = t.o_custkey""")
def stratified_group_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(folds.stratified_group(_orders(spark, sf_dir), "o_custkey", "o_orderpriority", 5).select("o_orderkey", "fold"))


_RANGES = f"WITH {DAILY_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS rows FROM daily), f AS (SELECT unnest(range(0, 4)) AS fold), x AS (SELECT r.day, r.i, fold, rows // 5 AS size, rows - 4 * (rows // 5) AS first FROM r, f)"


@query(f"{_RANGES} SELECT day, fold, CASE WHEN i < first + fold * size - 3 THEN 'train' ELSE 'valid' END AS role FROM x WHERE i < first + fold * size - 3 OR (i >= first + fold * size AND i < first + (fold + 1) * size)")
def time_series_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(folds.time_series_split(daily(spark, sf_dir), "day", 4, gap=3).select("day", "fold", "role"))


@query(f"{_RANGES} SELECT day, fold, CASE WHEN i < first + fold * size THEN 'train' ELSE 'valid' END AS role FROM x WHERE (i >= first + fold * size - 200 AND i < first + (fold + 1) * size)")
def sliding_window_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(folds.sliding_window_split(daily(spark, sf_dir), "day", 200, 4).select("day", "fold", "role"))


_CUTOFFS = ["2024-01-10", "2024-01-18", "2024-01-24"]


@query("""WITH c AS (SELECT * FROM (VALUES (0, TIMESTAMP '2024-01-10', TIMESTAMP '2024-01-18'), (1, TIMESTAMP '2024-01-18', TIMESTAMP '2024-01-24'), (2, TIMESTAMP '2024-01-24', TIMESTAMP '2024-01-28')) t(fold, a, b))
SELECT event_id, fold::BIGINT AS fold, CASE WHEN ts < a THEN 'train' ELSE 'valid' END AS role FROM events, c WHERE ts < b""")
def time_cutoff_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(folds.time_cutoff_split(events(spark, sf_dir), "ts", _CUTOFFS, "2024-01-28").select("event_id", "fold", "role"))


@query("SELECT event_id, (CASE WHEN ts >= TIMESTAMP '2024-01-24' THEN 2 WHEN ts >= TIMESTAMP '2024-01-18' THEN 1 WHEN ts >= TIMESTAMP '2024-01-10' THEN 0 ELSE -1 END)::BIGINT AS fold FROM events")
def fold_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    return tidy(folds.fold_ids(rows, folds.time_cutoff_split(rows, "ts", _CUTOFFS), "event_id").select("event_id", "fold"))


# -- regression metrics on a forecast that repeats last week -------------------------------------------------------

_NAIVE = f"WITH {BY_PRIORITY_SQL}, p AS (SELECT series, day, total AS y, lag(total, 7) OVER (PARTITION BY series ORDER BY day) AS p, row_number() OVER (PARTITION BY series ORDER BY day) AS step FROM panel), v AS (SELECT * FROM p WHERE p IS NOT NULL)"


def _naive(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windows.LagFeatures("total", [7, 14], "day", "series").transform(windows.step_index(panel(spark, sf_dir), "day", "series"))
    return rows.select("series", "day", "step", F.col("total").alias("y"), F.col("total_lag_7").alias("p"), F.col("total_lag_14").alias("p2"))


_SCORES = "round(sqrt(avg(pow(y - p, 2))), 3) AS rmse, round(avg(pow(y - p, 2)), 0) AS mse, round(avg(abs(y - p)), 3) AS mae, round(avg(abs(y - p) / greatest(abs(y), 2.220446049250313e-16)), 5) AS mape, round(1 - sum(pow(y - p, 2)) / (var_pop(y) * count(*)), 5) AS r2"


@query(f"{_NAIVE} SELECT series, count(*) AS n, {_SCORES} FROM v GROUP BY ROLLUP (series)")
def regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.regression_scores(_naive(spark, sf_dir), "y", "p", ["series"], rollup=True)
    return tidy(out.select("series", "n", F.round("rmse", 3).alias("rmse"), F.round("mse", 0).alias("mse"), F.round("mae", 3).alias("mae"), F.round("mape", 5).alias("mape"), F.round("r2", 5).alias("r2")))


@query(f"{_NAIVE} SELECT series, round(sqrt(avg(pow(ln(1 + y) - ln(1 + greatest(p, 0)), 2))), 6) AS rmsle FROM v GROUP BY 1")
def rmsle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(_naive(spark, sf_dir).filter("p is not null").groupBy("series").agg(metrics.rmsle("y", "p").alias("rmsle")))


@query(f"{_NAIVE} SELECT step % 28 AS step, count(*) AS n, round(avg(abs(y - p)), 3) AS score FROM v GROUP BY 1")
def horizon_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(metrics.horizon_scores(_naive(spark, sf_dir).filter("p is not null").withColumn("step", F.col("step") % 28), "y", "p", "step"), 3)


@query(f"{_NAIVE} SELECT series, count(*) FILTER (y BETWEEN 50000 AND 900000) AS n, round(avg(abs(y - p)) FILTER (y BETWEEN 50000 AND 900000), 3) AS mae FROM v GROUP BY ROLLUP (series)")
def rollup_mae(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.valid_mae(_naive(spark, sf_dir).filter("p is not null"), "series", "y", "p", F.col("y").between(50000, 900000))
    return tidy(out, 3)


@query(f"{_NAIVE}, s AS (SELECT step % 5 AS fold, sqrt(avg(pow(y - p, 2))) AS s FROM v GROUP BY 1) SELECT round(avg(s), 3) AS fold_mean, round(stddev_pop(s), 3) AS fold_std, count(*) AS n_folds, round((SELECT sqrt(avg(pow(y - p, 2))) FROM v), 3) AS oof_score FROM s")
def fold_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(metrics.fold_summary(_naive(spark, sf_dir).filter("p is not null").withColumn("fold", F.col("step") % 5), "y", "p", "fold"), 3)


@query(f"""{_NAIVE}, e AS (SELECT series, y - p AS e FROM v UNION ALL SELECT NULL, y - p FROM v), m AS (SELECT series, count(*) AS n, avg(e) AS m, var_pop(e) AS s2, stddev_samp(e) AS sd, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse FROM e GROUP BY 1)
SELECT m.series, n, round(m, 2) AS mean, round(sd, 2) AS std, round(avg(pow(e - m, 3)) / pow(s2, 1.5), 4) AS skewness, round(avg(pow(e - m, 4)) / (s2 * s2) - 3, 4) AS kurtosis, round(mae, 2) AS mae, round(rmse, 2) AS rmse
FROM e JOIN m ON e.series IS NOT DISTINCT FROM m.series GROUP BY m.series, n, m, sd, s2, mae, rmse""")
def residual_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.residual_summary(_naive(spark, sf_dir), "y", "p", "series")
    return tidy(out.withColumns({c: F.round(c, 2) for c in ("mean", "std", "mae", "rmse")}), 4)


# -- classification metrics: a score of documents from their length -----------------------------------------------

_LABELS = "WITH s AS (SELECT l.doc_id, toxic::BIGINT AS y, n_chars / (n_chars + 2000.0::DOUBLE) AS p, quality::BIGINT AS q, CASE WHEN n_chars < 800 THEN 0 WHEN n_chars < 2500 THEN 1 ELSE 2 END AS c, doc_id % 3 AS z FROM labels l JOIN documents d USING (doc_id))"


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    rows = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return rows.select("doc_id", F.col("toxic").cast("long").alias("y"), (n / (n + 2000.0)).alias("p"), F.when(n < 800, 0).when(n < 2500, 1).otherwise(2).alias("c"), (F.col("doc_id") % 3).cast("int").alias("z"))


@query(f"{_LABELS}, k AS (SELECT unnest(range(0, 3)) AS actual), j AS (SELECT unnest(range(0, 3)) AS predicted) SELECT actual, predicted, count(s.doc_id) AS n, round(coalesce(count(s.doc_id) / nullif(sum(count(s.doc_id)) OVER (PARTITION BY actual), 0)::DOUBLE, 0), 6) AS share FROM k CROSS JOIN j LEFT JOIN s ON z = actual AND c = predicted GROUP BY 1, 2")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(metrics.confusion(_labels(spark, sf_dir), "z", "c", [0, 1, 2]))


_PER_CLASS = f"""{_LABELS}, k AS (SELECT unnest(range(0, 3)) AS k), r AS (SELECT k, count(*) FILTER (z = k AND c = k)::DOUBLE AS tp, count(*) FILTER (z <> k AND c = k)::DOUBLE AS fp, count(*) FILTER (z = k AND c <> k)::DOUBLE AS fn FROM s, k GROUP BY 1),
a AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS pr, coalesce(tp / nullif(tp + fn, 0), 0) AS re, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f FROM r)"""


@query(f"""{_PER_CLASS} SELECT 'macro' AS average, round(avg(pr), 6) AS precision, round(avg(re), 6) AS recall, round(avg(f), 6) AS f1 FROM a
UNION ALL SELECT 'micro', round(sum(tp) / sum(tp + fp), 6), round(sum(tp) / sum(tp + fn), 6), round(2 * sum(tp) / sum(2 * tp + fp + fn), 6) FROM a
UNION ALL SELECT 'weighted', round(sum(pr * (tp + fn)) / sum(tp + fn), 6), round(sum(re * (tp + fn)) / sum(tp + fn), 6), round(sum(f * (tp + fn)) / sum(tp + fn), 6) FROM a""")
def f1_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(metrics.averaged_scores(metrics.confusion(_labels(spark, sf_dir), "z", "c", [0, 1, 2])))


@query(f"""{_PER_CLASS}, t AS (SELECT (SELECT count(*) FROM s)::DOUBLE AS s, sum(tp) AS c, sum((tp + fn) * (tp + fp)) AS tp_, sum(pow(tp + fn, 2)) AS tt, sum(pow(tp + fp, 2)) AS pp, CASE WHEN min(re) > 0 THEN exp(avg(ln(nullif(re, 0)))) ELSE 0 END AS g FROM a)
SELECT round(c / s, 6) AS accuracy, round((c * s - tp_) / sqrt((s * s - pp) * (s * s - tt)), 6) AS mcc, round(g, 6) AS g_mean FROM t""")
def mcc_gmean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(metrics.agreement_scores(metrics.confusion(_labels(spark, sf_dir), "z", "c", [0, 1, 2])))


_COUNTS = f"""{_LABELS}, d AS (SELECT p AS score, count(*) FILTER (y = 1) AS a, count(*) FILTER (y <> 1) AS b FROM s GROUP BY 1),
r AS (SELECT score, a, b, sum(a) OVER (ORDER BY score DESC)::DOUBLE AS tp, sum(b) OVER (ORDER BY score DESC)::DOUBLE AS fp, sum(a) OVER ()::DOUBLE AS pos, sum(b) OVER ()::DOUBLE AS neg FROM d)"""


@query(f"{_COUNTS} SELECT round(score, 6) AS score, round(fp / neg, 6) AS fpr, round(tp / pos, 6) AS tpr FROM r UNION ALL SELECT NULL, 0, 0")
def roc_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(metrics.roc_points(_labels(spark, sf_dir), "y", "p"))


@query(f"{_COUNTS} SELECT round(score, 6) AS score, round(tp / (tp + fp), 6) AS precision, round(tp / pos, 6) AS recall, round(pos / (pos + neg), 6) AS chance FROM r")
def pr_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(metrics.pr_points(_labels(spark, sf_dir), "y", "p"))


@query(f"""{_COUNTS}, x AS (SELECT *, fp / neg AS x1, (fp - b) / neg AS x0, tp / pos AS y1, (tp - a) / pos AS y0 FROM r), z AS (SELECT *, least(x1, 0.1) AS e FROM x),
u AS (SELECT sum(CASE WHEN e > x0 THEN (e - x0) * (y0 + y0 + coalesce((y1 - y0) / nullif(x1 - x0, 0), 0) * (e - x0)) / 2 ELSE 0 END) AS area, max(pos)::BIGINT AS n_pos, max(neg)::BIGINT AS n_neg, sum((x1 - x0) * (y0 + y1) / 2) AS auc, sum(a / pos * tp / (tp + fp)) AS ap FROM z)
SELECT n_pos, n_neg, round(auc, 6) AS roc_auc, round(ap, 6) AS average_precision, round(0.5 * (1 + (area - 0.005) / (0.1 - 0.005)), 6) AS pauc FROM u""")
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(metrics.ranking_scores(_labels(spark, sf_dir), "y", "p"))


@query(f"{_LABELS} SELECT round(avg(-CASE WHEN y = 1 THEN ln(p) ELSE ln(1 - p) END), 6) AS logloss FROM s")
def logloss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(_labels(spark, sf_dir).agg(metrics.logloss("y", "p").alias("logloss")))


# -- evaluation tables ---------------------------------------------------------------------------------------------


@query(f"""{_NAIVE}, e AS (SELECT y - p AS e FROM v), m AS (SELECT min(e) AS a, max(e) AS b FROM e) SELECT least(floor((e - a) / ((b - a) / 50)), 49)::BIGINT AS bin, count(*) AS n FROM e, m GROUP BY 1""")
def residual_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _naive(spark, sf_dir).filter("p is not null").withColumn("e", F.col("y") - F.col("p"))
    return evaluate.residual_histogram(rows, "e").select("bin", "n")


@query(f"""WITH {DAILY_SQL}, x AS (SELECT n::DOUBLE AS a, total AS b FROM daily), r AS (SELECT a, b, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0::DOUBLE AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0::DOUBLE AS rb FROM x)
SELECT count(*) AS n, round(corr(a, b), 6) AS pearson, round(corr(ra, rb), 6) AS spearman FROM r""")
def spearman_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(correlogram.pair_correlation(daily(spark, sf_dir), "n", "total"))


def _horner(x: str, coefficients: tuple[float, ...]) -> str:
    """The polynomial as SQL, highest power first."""
    out = f"{coefficients[0]!r}::DOUBLE"
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r}::DOUBLE)"
    return out


@query(f"""{_NAIVE}, e AS (SELECT series, day, y - p AS e FROM v), i AS (SELECT series, day, count(*) OVER w AS n, row_number() OVER (PARTITION BY series ORDER BY e, day) AS i, (e - avg(e) OVER w) / stddev_samp(e) OVER w AS z FROM e WINDOW w AS (PARTITION BY series)),
u AS (SELECT *, CASE WHEN i = 1 THEN 1 - pow(0.5, 1.0::DOUBLE / n) WHEN i = n THEN pow(0.5, 1.0::DOUBLE / n) ELSE (i - 0.3175::DOUBLE) / (n + 0.365::DOUBLE) END AS p FROM i), q AS (SELECT *, sqrt(-2 * ln(least(p, 1 - p))) AS t, (p - 0.5::DOUBLE) * (p - 0.5::DOUBLE) AS r FROM u)
SELECT series, day, round(CASE WHEN p BETWEEN 0.02425 AND 0.97575 THEN {_horner("r", exprs._A)} * (p - 0.5::DOUBLE) / {_horner("r", exprs._B)} ELSE sign(0.5 - p) * {_horner("t", exprs._C)} / {_horner("t", exprs._D)} END, 6) AS theoretical, round(z, 6) AS standardized FROM q""")
def qq_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _naive(spark, sf_dir).filter("p is not null").withColumn("e", F.col("y") - F.col("p"))
    return tidy(evaluate.qq_points(rows, "e", "day", ["series"]))


@query(f"""{_NAIVE} SELECT v.series, n, round(m - 2 * s, 2) AS low, round(m + 2 * s, 2) AS high FROM (SELECT series, count(*) AS n, avg(y - p) AS m, stddev_samp(y - p) AS s FROM v GROUP BY 1) v""")
def residual_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _naive(spark, sf_dir).filter("p is not null").select("series", "day", (F.col("y") - F.col("p")).alias("e"), (F.year("day") % 2).alias("fold"))
    out = evaluate.residual_bands(rows, "e", "day", "series", "fold")
    return tidy(out.groupBy("series").agg(F.count(F.lit(1)).alias("n"), F.first("low").alias("low"), F.first("high").alias("high")), 2)


@query("""WITH x AS (SELECT l_orderkey, l_partkey, l_quantity, l_discount, l_tax, l_extendedprice - 1500 * l_quantity AS e FROM lineitem),
m AS (SELECT count(*)::DOUBLE AS n, sum(e * e) AS sse, avg(l_quantity) AS m1, avg(l_discount) AS m2, avg(l_tax) AS m3, stddev_pop(l_quantity) AS s1, stddev_pop(l_discount) AS s2, stddev_pop(l_tax) AS s3,
  corr(l_quantity, l_discount) AS r12, corr(l_quantity, l_tax) AS r13, corr(l_discount, l_tax) AS r23 FROM x),
z AS (SELECT x.*, m.*, (l_quantity - m1) / s1 AS a, (l_discount - m2) / s2 AS b, (l_tax - m3) / s3 AS c FROM x, m),
h AS (SELECT *, (1 + ((1 - r23 * r23) * a * a + (1 - r13 * r13) * b * b + (1 - r12 * r12) * c * c + 2 * ((r13 * r23 - r12) * a * b + (r12 * r23 - r13) * a * c + (r12 * r13 - r23) * b * c))
  / (1 + 2 * r12 * r13 * r23 - r12 * r12 - r13 * r13 - r23 * r23)) / n AS h FROM z),
t AS (SELECT *, e / sqrt(sse / (n - 4) * (1 - h)) AS t FROM h)
SELECT l_orderkey, l_partkey, l_quantity, l_discount, l_tax, round(e, 6) AS e, round(h, 6) AS leverage, round(t, 6) AS standardized_residual, round(t * t * h / ((1 - h) * 4), 6) AS cooks_distance FROM t WHERE t * t * h / ((1 - h) * 4) > 4 / n""")
def cooks_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_discount", "l_tax", (F.col("l_extendedprice") - 1500 * F.col("l_quantity")).alias("e"))
    return tidy(correlogram.above_threshold(correlogram.influence(rows, ["l_quantity", "l_discount", "l_tax"], "e")))


# -- ensembles -----------------------------------------------------------------------------------------------------

_TWO = f"WITH {BY_PRIORITY_SQL}, q AS (SELECT series, day, total AS y, lag(total, 7) OVER w AS a, lag(total, 14) OVER w AS b, row_number() OVER w % 4 AS fold FROM panel WINDOW w AS (PARTITION BY series ORDER BY day)), t AS (SELECT * FROM q WHERE b IS NOT NULL)"


def _two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _naive(spark, sf_dir).filter("p2 is not null").select("series", "day", "y", F.col("p").alias("a"), F.col("p2").alias("b"), (F.col("step") % 4).alias("fold"))


@query(f"{_TWO} SELECT series, day, round((a + b) / 2, 3) AS pred FROM t")
def ensemble_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(_two(spark, sf_dir).select("series", "day", ensembles.mean_blend(["a", "b"]).alias("pred")), 3)


@query(f"""{_TWO}, r AS (SELECT series, day, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0::DOUBLE AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0::DOUBLE AS rb, count(*) OVER () AS n FROM t)
SELECT series, day, round(((ra - 1) / (n - 1) + (rb - 1) / (n - 1)) / 2, 6) AS pred FROM r""")
def rank_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(ensembles.rank_mean_blend(_two(spark, sf_dir), ["a", "b"]).select("series", "day", "pred"))


@query(f"{_TWO}, w AS (SELECT unnest(range(0, 11)) AS weight_id) SELECT fold, weight_id, round(sum(pow(weight_id / 10.0::DOUBLE * a + (10 - weight_id) / 10.0::DOUBLE * b - y, 2)) / 1e9, 4) AS sse, count(*) AS n FROM t, w GROUP BY 1, 2")
def weighted_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ensembles.grid_scores(_two(spark, sf_dir), ["a", "b"], "y", ensembles.weight_grid(2, 10), "fold")
    return tidy(out.withColumn("sse", F.col("sse") / 1e9), 4)


_VECTORS = [(0, k, (k / 10, (10 - k) / 10)) for k in range(11)]


@query(f"{_TWO}, w AS (SELECT unnest(range(0, 11)) AS weight_id) SELECT weight_id, round(avg(abs(weight_id / 10.0::DOUBLE * a + (10 - weight_id) / 10.0::DOUBLE * b - y)), 3) AS score FROM t, w GROUP BY 1")
def weighted_grid_mae(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(ensembles.vector_scores(_two(spark, sf_dir), ["a", "b"], "y", "mae", _VECTORS).drop("set"), 3)


@query(f"""{_TWO}, w AS (SELECT unnest(range(0, 11)) AS weight_id), x AS (SELECT weight_id, weight_id / 10.0::DOUBLE * a + (10 - weight_id) / 10.0::DOUBLE * b AS p, y > 150000 AS hit FROM t, w),
r AS (SELECT *, rank() OVER (PARTITION BY weight_id ORDER BY p) + (count(*) OVER (PARTITION BY weight_id, p) - 1) / 2.0::DOUBLE AS r FROM x)
SELECT weight_id, round((sum(r) FILTER (hit) - count(*) FILTER (hit) * (count(*) FILTER (hit) + 1) / 2.0::DOUBLE) / (count(*) FILTER (hit) * count(*) FILTER (NOT hit)), 6) AS score FROM r GROUP BY 1""")
def weighted_grid_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _two(spark, sf_dir).withColumn("hit", (F.col("y") > 150000).cast("int"))
    return tidy(ensembles.vector_scores(rows, ["a", "b"], "hit", "roc_auc", _VECTORS).drop("set"))


@query()
def crossfit_blend_mae(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fold blended with the weights of the least absolute error on the others."""
    return tidy(ensembles.cross_fit_by_metric(_two(spark, sf_dir), ["a", "b"], "y", "fold", "mae").select("series", "day", "pred"), 3)


@query(f"""{_TWO}, w AS (SELECT unnest(range(0, 11)) AS k), g AS (SELECT fold, k, sum(pow(k / 10.0::DOUBLE * a + (10 - k) / 10.0::DOUBLE * b - y, 2)) AS sse FROM t, w GROUP BY 1, 2),
o AS (SELECT fold, k, sum(sse) OVER (PARTITION BY k) - sse AS o FROM g), c AS (SELECT fold, k FROM o QUALIFY row_number() OVER (PARTITION BY fold ORDER BY o, k) = 1)
SELECT series, day, round(k / 10.0::DOUBLE * a + (10 - k) / 10.0::DOUBLE * b, 3) AS pred FROM t JOIN c ON t.fold = c.fold""")
def crossfit_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(ensembles.cross_fit_blend(_two(spark, sf_dir), ["a", "b"], "y", "fold", 10).select("series", "day", "pred"), 3)


@query(f"{_TWO} SELECT model, count(*) AS n, round(sqrt(avg(pow(v - y, 2))), 3) AS rmse FROM (SELECT y, a, b, (a + b) / 2 AS mean FROM t) UNPIVOT (v FOR model IN (a, b, mean)) GROUP BY 1")
def member_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _two(spark, sf_dir).withColumn("mean", ensembles.mean_blend(["a", "b"]))
    return tidy(ensembles.member_scores(rows, ["a", "b", "mean"], "y"), 3)


@query(f"{_TWO}, m AS (SELECT model, avg(abs(v - y)) AS s FROM t UNPIVOT (v FOR model IN (a, b)) GROUP BY 1) SELECT model, round(s, 3) AS score, rank() OVER (ORDER BY s) AS rank FROM m")
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = _two(spark, sf_dir).unpivot(["y"], ["a", "b"], "model", "v").groupBy("model").agg(metrics.mae("y", "v").alias("score"))
    return tidy(models.leaderboard(long), 3)


@query()
def balanced_group_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers stay whole; the statuses of their orders are spread evenly."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    out = folds.balanced_group(o, "o_custkey", "o_orderstatus", 5)
    return tidy(out.groupBy("fold", "o_orderstatus").agg(F.count(F.lit(1)).alias("n")))


# -- models --------------------------------------------------------------------------------------------------------


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"), F.count(F.lit(1)).cast("double").alias("lines"), F.sum("l_extendedprice").alias("price"))
    return folds.kfold(rows, "l_orderkey", 3, shuffle=True)


def _lines_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in folds that SQL knows too."""
    return _lines(spark, sf_dir).withColumn("fold", (F.col("l_orderkey") % 3).cast("int"))


def _least_squares(reg: float = 0.0) -> str:
    """Table ``fit``: of each fold the means and coefficients of a linear model of the other rows of ``l`` (x1, x2, x3, y), from correlations with ``reg`` over y's deviation added to the diagonal."""
    return f"""f AS (SELECT DISTINCT fold FROM l), m AS (SELECT f.fold, avg(x1) AS m1, avg(x2) AS m2, avg(x3) AS m3, avg(y) AS my, stddev_pop(x1) AS s1, stddev_pop(x2) AS s2, stddev_pop(x3) AS s3, stddev_pop(y) AS sy, corr(x1, x2) AS r12, corr(x1, x3) AS r13, corr(x2, x3) AS r23,
  corr(x1, y) AS q1, corr(x2, y) AS q2, corr(x3, y) AS q3, 1 + {reg!r}::DOUBLE / stddev_pop(y) AS u FROM l JOIN f ON l.fold <> f.fold GROUP BY 1), d AS (SELECT *, u * u * u + 2 * r12 * r13 * r23 - u * (r12 * r12 + r13 * r13 + r23 * r23) AS det FROM m),
fit AS (SELECT fold, my, m1, m2, m3, ((u * u - r23 * r23) * q1 + (r13 * r23 - u * r12) * q2 + (r12 * r23 - u * r13) * q3) / det * sy / s1 AS b1,
  ((r13 * r23 - u * r12) * q1 + (u * u - r13 * r13) * q2 + (r12 * r13 - u * r23) * q3) / det * sy / s2 AS b2, ((r12 * r23 - u * r13) * q1 + (r12 * r13 - u * r23) * q2 + (u * u - r12 * r12) * q3) / det * sy / s3 AS b3 FROM d)"""


_LINES = "WITH l AS (SELECT l_orderkey, sum(l_quantity) AS x1, avg(l_discount) AS x2, count(*)::DOUBLE AS x3, sum(l_extendedprice) AS y, l_orderkey % 3 AS fold FROM lineitem GROUP BY 1)"


@query(f"{_LINES}, {_least_squares(0.1)} SELECT l_orderkey, l.fold, round(y, 2) AS price, round(my + b1 * (x1 - m1) + b2 * (x2 - m2) + b3 * (x3 - m3), 1) AS pred FROM l JOIN fit ON l.fold = fit.fold")
def oof_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = ridge.ridge_cv(_lines_by_key(spark, sf_dir), ["quantity", "discount", "lines"], "price", "l_orderkey", reg=0.1)
    return tidy(out.withColumn("pred", F.round("pred", 1)), 2)


@query()
def oof_boosted_early(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees stopped by each fold's own rows, then all rows predicted by a refit with the folds' mean best iteration."""
    rows, features = written(_lines(spark, sf_dir)), ["quantity", "discount", "lines"]
    pipeline = models.make_pipeline(models.model_factory("gbt", "regression", "price", maxIter=10, maxDepth=4, stepSize=0.3), features)
    out, fitted = models.run_cv(rows, pipeline, "regression", "l_orderkey", "price", early=True)
    whole = models.predict_test(rows, "regression", "l_orderkey", refit=models.refit(rows, pipeline, fitted))
    return tidy(out.join(whole.withColumnRenamed("pred", "pred_refit"), "l_orderkey"), 3)


def _ridge_sql(reg: float) -> str:
    return f"(WITH {_least_squares(reg)} SELECT l_orderkey, l.fold, y, my + b1 * (x1 - m1) + b2 * (x2 - m2) + b3 * (x3 - m3) AS pred FROM l JOIN fit ON l.fold = fit.fold)"


def _members(**options) -> list[selection.Member]:
    common = {"target": "price", "key": "l_orderkey", "metric": "mae", **options}
    return [selection.ridge_member(n, ["quantity", "discount", "lines"], params={"reg": r}, **common) for n, r in (("light", 0.1), ("heavy", 50_000.0))]


@query(f"""{_LINES}, a AS {_ridge_sql(0.1)}, b AS {_ridge_sql(50_000.0)}, t AS (SELECT a.y, a.pred AS light, b.pred AS heavy, (a.pred + b.pred) / 2 AS mean FROM a JOIN b ON a.l_orderkey = b.l_orderkey),
s AS (SELECT 'member' AS kind, 'light' AS name, avg(abs(y - light)) AS score FROM t UNION ALL SELECT 'member', 'heavy', avg(abs(y - heavy)) FROM t UNION ALL SELECT 'blend', 'mean', avg(abs(y - mean)) FROM t)
SELECT kind, name, round(score, 1) AS score, rank() OVER (ORDER BY score) AS rank, score = min(score) OVER () AS chosen FROM s""")
def model_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ridges and their mean on the same rows; the best is chosen."""
    return tidy(selection.select_model(_lines_by_key(spark, sf_dir), _members(), ["mean"]).summary, 1)


@query()
def median_stop_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trials of a search over the penalty of a ridge; those under the median of the others are stopped after a fold."""
    member = selection.ridge_member("ridge", ["quantity", "discount", "lines"], target="price", key="l_orderkey", space={"reg": ("float", 0.1, 1e6, "log")}, trials=8)
    _, rows = selection.searched(_lines_by_key(spark, sf_dir), member)
    return tidy(models.trials_table(spark, rows).select("trial", F.round(F.col("params")["reg"].cast("double"), 3).alias("reg"), "state", "rungs", F.round("score", 3).alias("score")), 3)


_ATTRIBUTED = f"{_LINES}, {_least_squares()}, a AS (SELECT l.*, b1 * (x1 - m1) AS a1, b2 * (x2 - m2) AS a2, b3 * (x3 - m3) AS a3 FROM l JOIN fit ON l.fold = fit.fold)"


@query(f"{_ATTRIBUTED} SELECT l_orderkey, fold, round(a1, 1) AS attr_quantity, round(a2, 1) AS attr_discount, round(a3, 1) AS attr_lines FROM a")
def linear_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ridge.ridge_attributions(_lines_by_key(spark, sf_dir), ["quantity", "discount", "lines"], "price", "fold")
    return tidy(out.select("l_orderkey", "fold", "attr_quantity", "attr_discount", "attr_lines"), 1)


@query(f"""{_ATTRIBUTED}, x AS (SELECT 'quantity' AS feature, x1 AS x, a1 AS a FROM a UNION ALL SELECT 'discount', x2, a2 FROM a UNION ALL SELECT 'lines', x3, a3 FROM a),
r AS (SELECT feature, x, a, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY feature ORDER BY a) + (count(*) OVER (PARTITION BY feature, a) - 1) / 2.0::DOUBLE AS ra FROM x),
c AS (SELECT feature, count(*) AS n, corr(x, a) AS pearson, corr(rx, ra) AS spearman FROM r GROUP BY 1)
SELECT feature, n, round(pearson, 4) AS pearson, round(spearman, 4) AS spearman, CASE WHEN spearman > 0.05 THEN '+' WHEN spearman < -0.05 THEN '-' ELSE 'none' END AS direction FROM c""")
def attribution_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ridge.ridge_attributions(_lines_by_key(spark, sf_dir), ["quantity", "discount", "lines"], "price", "fold")
    return tidy(evaluate.attribution_correlation(out, ["quantity", "discount", "lines"]), 4)


#: One fit on all rows of ``t`` (x1, x2, x3, y): that of fold 0, which only a row without values is in.
_ALL_ROWS = "l AS (SELECT x1, x2, x3, y, -1 AS fold FROM t WHERE x1 IS NOT NULL AND x2 IS NOT NULL AND x3 IS NOT NULL UNION ALL SELECT NULL, NULL, NULL, NULL, 0)"


@query(f"""WITH RECURSIVE {BY_PRIORITY_SQL}, t AS (SELECT total AS y, lag(total) OVER w AS x1, lag(total, 7) OVER w AS x2, avg(total) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS x3 FROM panel WHERE day < '2001-06-01' WINDOW w AS (PARTITION BY series ORDER BY day)),
{_ALL_ROWS}, {_least_squares()}, h AS (SELECT series, list(total ORDER BY day)[-7:] AS past FROM panel WHERE day < '2001-06-01' GROUP BY 1), a AS (SELECT series, day, row_number() OVER (PARTITION BY series ORDER BY day) AS step FROM panel WHERE day >= '2001-06-01'),
g(series, step, past) AS (SELECT series, 0::BIGINT, past FROM h UNION ALL SELECT g.series, g.step + 1, list_append(past[2:], my + b1 * (past[7] - m1) + b2 * (past[1] - m2) + b3 * (list_avg(past) - m3)) FROM g, fit WHERE fold = 0 AND EXISTS (SELECT 1 FROM a WHERE a.series = g.series AND a.step = g.step + 1))
SELECT a.series, day, a.step, round(greatest(past[7], 0), 1) AS pred FROM a JOIN g ON a.series = g.series AND a.step = g.step""")
def recursive_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = panel(spark, sf_dir)
    history, future = rows.filter("day < '2001-06-01'"), rows.filter("day >= '2001-06-01'")
    model = forecasts.fit_linear_history(history, "total", "day", "series", lags=[1, 7], windows=[7])
    return tidy(forecasts.recursive_forecast(model, history, future, "total", "day", "series", low=0.0), 1)


#: Between bounds that many steps cross; a clipped step is the past of the next.
_LOW, _HIGH = 120_000, 200_000


@query(f"""WITH RECURSIVE {BY_PRIORITY_SQL}, t AS (SELECT total AS y, lag(total) OVER w AS x1, lag(total, 7) OVER w AS x2, avg(total) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS x3 FROM panel WHERE day < '2001-06-01' WINDOW w AS (PARTITION BY series ORDER BY day)),
{_ALL_ROWS}, {_least_squares()}, h AS (SELECT series, list(total ORDER BY day)[-7:] AS past FROM panel WHERE day < '2001-06-01' GROUP BY 1), a AS (SELECT series, day, row_number() OVER (PARTITION BY series ORDER BY day) AS step FROM panel WHERE day >= '2001-06-01'),
g(series, step, past) AS (SELECT series, 0::BIGINT, past FROM h UNION ALL SELECT g.series, g.step + 1, list_append(past[2:], least(greatest(my + b1 * (past[7] - m1) + b2 * (past[1] - m2) + b3 * (list_avg(past) - m3), {_LOW}), {_HIGH})) FROM g, fit WHERE fold = 0 AND EXISTS (SELECT 1 FROM a WHERE a.series = g.series AND a.step = g.step + 1))
SELECT a.series, day, a.step, round(past[7], 1) AS pred FROM a JOIN g ON a.series = g.series AND a.step = g.step""")
def recursive_clipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = panel(spark, sf_dir)
    history, future = rows.filter("day < '2001-06-01'"), rows.filter("day >= '2001-06-01'")
    model = forecasts.fit_linear_history(history, "total", "day", "series", lags=[1, 7], windows=[7])
    return tidy(forecasts.recursive_forecast(model, history, future, "total", "day", "series", low=_LOW, high=_HIGH), 1)


@query()
def forecast_future_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of two folds' models, each from the whole history."""
    rows = panel(spark, sf_dir)
    history, future = rows.filter("day < '2001-06-01'"), rows.filter("day >= '2001-06-01'")
    return tidy(forecasts.forecast_future(history, future, "total", "day", "series", {"lags": [1, 7], "difference": 7}, ["2000-06-01", "2001-01-01"], low=0.0), 1)


def _backtest_sql(there: str, back: str) -> str:
    """The backtest on weekly differences of a transformed total: of each cut a fit of two lags on the rows before, 28 steps ahead, and one step from the true past."""
    return f"""WITH RECURSIVE {BY_PRIORITY_SQL}, cuts(k, a, b) AS (VALUES (0, '2000-06-01', '2001-01-01'), (1, '2001-01-01', '9999-12-31')), y AS (SELECT series, day, total, {there} AS y FROM panel),
z AS (SELECT *, y - lag(y, 7) OVER (PARTITION BY series ORDER BY day) AS z FROM y), x AS (SELECT *, lag(z) OVER w AS x1, lag(z, 7) OVER w AS x2, y - z AS base FROM z WINDOW w AS (PARTITION BY series ORDER BY day)),
l AS (SELECT k, z, x1, x2 FROM x, cuts WHERE day < a AND x2 IS NOT NULL), m AS (SELECT k, avg(x1) AS m1, avg(x2) AS m2, avg(z) AS mz, stddev_pop(z) / stddev_pop(x1) AS s1, stddev_pop(z) / stddev_pop(x2) AS s2, corr(x1, x2) AS r, corr(x1, z) AS q1, corr(x2, z) AS q2 FROM l GROUP BY 1),
fit AS (SELECT k, mz, m1, m2, (q1 - r * q2) / (1 - r * r) * s1 AS b1, (q2 - r * q1) / (1 - r * r) * s2 AS b2 FROM m), h AS (SELECT k, series, list(y ORDER BY day)[-7:] AS ys, list(z ORDER BY day)[-7:] AS zs FROM z, cuts WHERE day < a GROUP BY 1, 2),
g(k, series, step, ys, zs) AS (SELECT k, series, 0::BIGINT, ys, zs FROM h UNION ALL SELECT k, series, step + 1, list_append(ys[2:], ys[1] + d), list_append(zs[2:], d) FROM (SELECT g.*, mz + b1 * (zs[7] - m1) + b2 * (zs[1] - m2) AS d FROM g JOIN fit ON g.k = fit.k WHERE step < 28) t),
v AS (SELECT k, x.*, row_number() OVER (PARTITION BY k, series ORDER BY day) AS step FROM x, cuts WHERE day >= a AND day < b), p AS (SELECT v.*, ys[7] AS ahead, base + mz + b1 * (x1 - m1) + b2 * (x2 - m2) AS one FROM v JOIN g ON v.k = g.k AND v.series = g.series AND v.step = g.step JOIN fit ON v.k = fit.k)
SELECT k::BIGINT AS fold, series, day, step, total AS target, round({back.format("ahead")}, 1) AS pred, round({back.format("one")}, 1) AS pred_one_step FROM p"""


def _backtest(spark: SparkSession, sf_dir: str, options: dict) -> DataFrame:
    out = forecasts.recursive_backtest(panel(spark, sf_dir), "total", "day", "series", ["2000-06-01", "2001-01-01"], 28, options)
    return tidy(out.withColumns({c: F.round(c, 1) for c in ("pred", "pred_one_step")}), 2)


@query(_backtest_sql("total", "{}"))
def backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _backtest(spark, sf_dir, {"lags": [1, 7], "difference": 7})


@query(_backtest_sql("ln(total + 1)", "exp({}) - 1"))
def backtest_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _backtest(spark, sf_dir, {"lags": [1, 7], "difference": 7, "log_offset": 1.0})


@query(f"""{_TWO}, l AS (SELECT series || ' ' || day AS key, fold, y, a AS x1, b AS x2 FROM t), f AS (SELECT DISTINCT fold FROM l),
m AS (SELECT f.fold, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, stddev_pop(y) / stddev_pop(x1) AS s1, stddev_pop(y) / stddev_pop(x2) AS s2, corr(x1, x2) AS r, corr(x1, y) AS q1, corr(x2, y) AS q2 FROM l JOIN f ON l.fold <> f.fold GROUP BY 1)
SELECT key, l.fold, y, round(my + (q1 - r * q2) / (1 - r * r) * s1 * (x1 - m1) + (q2 - r * q1) / (1 - r * r) * s2 * (x2 - m2), 1) AS pred FROM l JOIN m ON l.fold = m.fold""")
def stacking(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _two(spark, sf_dir).withColumn("key", F.concat_ws(" ", "series", "day"))
    return tidy(ensembles.stack(rows, ["a", "b"], "y", "key").withColumn("pred", F.round("pred", 1)), 2)
