"""Labels, multiclass metrics, residual tables and attributions, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import clip
from ..operators import categorical, dates, difference, evaluate, folds, joins, metrics, profile
from .model_queries import _LABELS, _NAIVE, _labels, _naive
from .registry import BY_PRIORITY_SQL, DAILY_SQL, daily, events, panel, query, read, tidy

# -- columns and rows ----------------------------------------------------------------------------------------------


@query("SELECT event_id, round(CASE WHEN value < 10 THEN 10 WHEN value > 100 THEN 100 ELSE value END, 6) AS clipped FROM events")
def clip_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(events(spark, sf_dir).select("event_id", clip("value", 10.0, 100.0).alias("clipped")))


@query("SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS label FROM orders")
def label_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(categorical.encode_target(read(spark, sf_dir, "orders"), "o_orderpriority")[0].select("o_orderkey", "label"))


@query("SELECT event_id, round(epoch_us(ts) / 1e6::DOUBLE, 3) AS axis FROM events")
def axis_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("event_id", F.col("ts").cast("string").alias("ts"))
    return tidy(rows.select("event_id", dates.axis_value("ts").alias("axis")), 3)


@query(f"WITH {DAILY_SQL}, r AS (SELECT day, total, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS n FROM daily) SELECT day, total FROM r WHERE i >= n - floor(0.2::DOUBLE * n)")
def most_recent_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(folds.most_recent(daily(spark, sf_dir), "day", 0.2).select("day", "total"), 2)


@query(f"WITH {BY_PRIORITY_SQL} SELECT series, day, CASE WHEN count(total) OVER w = 5 THEN round(avg(total) OVER w, 3) END AS total_smoothed FROM panel WINDOW w AS (PARTITION BY series ORDER BY day ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def smoothed_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(difference.smoothed(panel(spark, sf_dir), "total", "day", "series").select("series", "day", "total_smoothed"), 3)


@query("""WITH a AS (SELECT o_orderkey AS k, o_totalprice AS t, o_custkey % 5 AS f FROM orders), b AS (SELECT k, CASE WHEN k % 7 = 0 THEN t + 1 ELSE t END AS t, CASE WHEN k % 11 = 0 THEN f + 1 ELSE f END AS f FROM a WHERE k % 13 <> 0),
r AS (SELECT CASE WHEN b.k IS NULL THEN 'rows' WHEN a.t <> b.t THEN 'target' WHEN a.f <> b.f THEN 'fold' END AS reason FROM a LEFT JOIN b ON a.k = b.k) SELECT 'second' AS member, reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY 2""")
def member_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("target"), (F.col("o_custkey") % 5).alias("fold"))
    key = F.col("key")
    second = first.filter(key % 13 != 0).select("key", F.when(key % 7 == 0, F.col("target") + 1).otherwise(F.col("target")).alias("target"), F.when(key % 11 == 0, F.col("fold") + 1).otherwise(F.col("fold")).alias("fold"))
    return tidy(joins.member_mismatches({"first": first, "second": second}))


# -- metrics of three classes: probabilities of documents from their length ------------------------------------------

_CLASSES = f"{_LABELS}, m AS (SELECT doc_id, z, p AS p0, 0.6::DOUBLE * (1 - p) AS p1, 0.4::DOUBLE * (1 - p) AS p2 FROM s)"
_REST = f"{_CLASSES}, o AS (SELECT 0 AS class, (z = 0)::INT AS hit, p0 AS score FROM m UNION ALL SELECT 1, (z = 1)::INT, p1 FROM m UNION ALL SELECT 2, (z = 2)::INT, p2 FROM m)"


def _classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labels(spark, sf_dir).select("doc_id", "z", F.col("p").alias("p0"), (0.6 * (1 - F.col("p"))).alias("p1"), (0.4 * (1 - F.col("p"))).alias("p2"))


@query(f"{_CLASSES} SELECT doc_id, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END::BIGINT AS label, (p0 >= 0.5)::BIGINT AS positive FROM m")
def predicted_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(_classes(spark, sf_dir).select("doc_id", metrics.argmax_label(["p0", "p1", "p2"]).alias("label"), metrics.binary_label("p0").alias("positive")))


@query(f"{_CLASSES} SELECT round(avg(-ln(CASE z WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END)), 6) AS logloss FROM m")
def multiclass_logloss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(_classes(spark, sf_dir).agg(metrics.multiclass_logloss("z", ["p0", "p1", "p2"]).alias("logloss")))


_REST_COUNTS = f"""{_REST}, d AS (SELECT class, score, count(*) FILTER (hit = 1) AS a, count(*) FILTER (hit = 0) AS b FROM o GROUP BY 1, 2),
r AS (SELECT class, score, a, b, sum(a) OVER w::DOUBLE AS tp, sum(b) OVER w::DOUBLE AS fp, sum(a) OVER (PARTITION BY class)::DOUBLE AS pos, sum(b) OVER (PARTITION BY class)::DOUBLE AS neg FROM d WINDOW w AS (PARTITION BY class ORDER BY score DESC))"""


@query(f"{_REST_COUNTS}, u AS (SELECT class, sum(b / neg * ((tp - a) + tp) / 2 / pos) AS auc FROM r GROUP BY 1) SELECT round(avg(auc), 6) AS roc_auc FROM u")
def multiclass_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(metrics.multiclass_auc(_classes(spark, sf_dir), "z", ["p0", "p1", "p2"]))


@query(f"{_REST_COUNTS} SELECT class, round(score, 6) AS score, round(fp / neg, 6) AS fpr, round(tp / pos, 6) AS tpr FROM r UNION ALL SELECT DISTINCT class, NULL, 0, 0 FROM r")
def one_vs_rest_roc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(metrics.roc_points(metrics.one_vs_rest(_classes(spark, sf_dir), "z", ["p0", "p1", "p2"]), "hit", "score", ["class"]))


# -- residuals -------------------------------------------------------------------------------------------------------


def _residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _naive(spark, sf_dir).filter("p is not null").select("series", "day", (F.col("y") - F.col("p")).alias("e"), (F.year("day") % 2).alias("fold"))


@query(f"""{_NAIVE.replace("WITH", "WITH RECURSIVE", 1)}, x AS (SELECT series, y - p - avg(y - p) OVER (PARTITION BY series) AS x, row_number() OVER (PARTITION BY series ORDER BY day) AS i, count(*) OVER (PARTITION BY series) AS n FROM v),
s AS (SELECT series, n, sum(x * x) AS s0 FROM x GROUP BY 1, 2), k AS (SELECT unnest(range(0, 21)) AS lag), c AS (SELECT a.series, k.lag, sum(a.x * b.x) AS s FROM x a, k, x b WHERE a.series = b.series AND b.i = a.i + k.lag GROUP BY 1, 2),
r AS (SELECT c.series, n, list(c.s / s.s0 ORDER BY c.lag) AS r FROM c JOIN s ON c.series = s.series GROUP BY 1, 2),
d(series, n, r, k, phi, last) AS (SELECT series, n, r, 0::BIGINT, []::DOUBLE[], 1.0::DOUBLE FROM r UNION ALL
  SELECT series, n, r, k + 1, list_append(list_transform(range(1, k + 1), lambda i: phi[i] - next * phi[k + 1 - i]), next), next
  FROM (SELECT *, (r[k + 2] - coalesce(list_sum(list_transform(range(1, k + 1), lambda i: phi[i] * r[k + 2 - i])), 0)) / (1 - coalesce(list_sum(list_transform(range(1, k + 1), lambda i: phi[i] * r[i + 1])), 0)) AS next FROM d WHERE k + 1 < len(r)) t)
SELECT series, n, k AS lag, round(r[k + 1], 6) AS acf, round(last, 6) AS pacf, round(1.96 / sqrt(n), 6) AS band FROM d""")
def residual_correlogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(evaluate.residual_correlogram(_residuals(spark, sf_dir), "e", "day", "series", 20))


@query(f"""{_NAIVE}, e AS (SELECT series, day, y - p AS e, year(day::DATE) % 2 AS fold FROM v), c AS (SELECT *, lag(fold) OVER (PARTITION BY series ORDER BY day) AS was, count(*) OVER (PARTITION BY series) AS n FROM e),
b AS (SELECT *, sum((fold <> coalesce(was, fold))::INT) OVER (PARTITION BY series ORDER BY day) AS block, greatest(7, n // 20) AS width FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY series, block ORDER BY day) AS i FROM b)
SELECT x.series, x.day, CASE WHEN count(y.e) >= any_value(x.width) // 2 THEN round(avg(y.e) / 3.14159::DOUBLE, 3) END AS rolling FROM r x JOIN r y ON x.series = y.series AND x.block = y.block AND y.i <= x.i AND y.i > x.i - x.width GROUP BY 1, 2""")
def residual_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    # means of cents often end in a half cent, which either side may round up; a share of them does not
    out = evaluate.residual_bands(_residuals(spark, sf_dir), "e", "day", "series", "fold")
    return tidy(out.select("series", "day", (F.col("rolling") / 3.14159).alias("rolling")), 3)


@query(f"""{_NAIVE}, e AS (SELECT y - p AS e FROM v), m AS (SELECT min(e) AS a, (max(e) - min(e)) / 50 AS w, avg(e) AS m, stddev_samp(e) AS s, count(*) AS n FROM e), h AS (SELECT least(floor((e - a) / w), 49)::BIGINT AS bin, count(*) AS n FROM e, m GROUP BY 1)
SELECT bin, h.n, round(a + bin * w, 2) AS low, round(a + (bin + 1) * w, 2) AS high, round(exp(-pow((a + (bin + 0.5::DOUBLE) * w - m) / s, 2) / 2) / (s * sqrt(2 * pi())) * m.n * w, 4) AS normal_n FROM h, m""")
def residual_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.residual_histogram(_residuals(spark, sf_dir), "e")
    return tidy(out.select("bin", "n", F.round("low", 2).alias("low"), F.round("high", 2).alias("high"), F.round("normal_n", 4).alias("normal_n")))


# -- attributions of a given linear rule -------------------------------------------------------------------------------

_ATTRIBUTED = "WITH t AS (SELECT l_quantity AS quantity, l_discount AS discount, l_tax AS tax, 3 * (l_quantity - 25) + 40 * l_tax AS attr_quantity, -400 * (l_discount - 0.05) AS attr_discount, 0.5 * l_tax * l_quantity AS attr_tax FROM lineitem)"
_FEATURES = ["quantity", "discount", "tax"]


def _attributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, d, t = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    return read(spark, sf_dir, "lineitem").select(q.alias("quantity"), d.alias("discount"), t.alias("tax"), (3 * (q - 25) + 40 * t).alias("attr_quantity"), (-400 * (d - 0.05)).alias("attr_discount"), (0.5 * t * q).alias("attr_tax"))


_LONG = f"{_ATTRIBUTED}, x AS (SELECT 'quantity' AS feature, quantity AS x, attr_quantity AS a FROM t UNION ALL SELECT 'discount', discount, attr_discount FROM t UNION ALL SELECT 'tax', tax, attr_tax FROM t)"


@query(f"{_LONG} SELECT feature, round(avg(abs(a)), 4) AS importance FROM x GROUP BY 1")
def attribution_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _attributed(spark, sf_dir).select(*[F.col(f"attr_{c}").alias(c) for c in _FEATURES])
    return tidy(evaluate.importance(rows, _FEATURES), 4)


@query(f"{_LONG}, i AS (SELECT feature, avg(abs(a)) AS importance FROM x GROUP BY 1) SELECT feature, row_number() OVER (ORDER BY importance DESC, feature) AS place FROM i ORDER BY place LIMIT 2")
def top_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _attributed(spark, sf_dir).select(*[F.col(f"attr_{c}").alias(c) for c in _FEATURES])
    return spark.createDataFrame(list(enumerate(evaluate.top_features(rows, _FEATURES, 2), 1)), "place long, feature string").select("feature", "place")


@query(f"""{_LONG}, r AS (SELECT feature, x, a, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY feature ORDER BY a) + (count(*) OVER (PARTITION BY feature, a) - 1) / 2.0::DOUBLE AS ra FROM x),
c AS (SELECT feature, count(*) AS n, corr(x, a) AS pearson, corr(rx, ra) AS spearman FROM r GROUP BY 1) SELECT feature, n, round(pearson, 5) AS pearson, round(spearman, 5) AS spearman, CASE WHEN spearman > 0.05 THEN '+' WHEN spearman < -0.05 THEN '-' ELSE 'none' END AS direction FROM c""")
def attribution_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(evaluate.attribution_correlation(_attributed(spark, sf_dir), _FEATURES), 5)


@query(f"""{_ATTRIBUTED}, n AS (SELECT count(*) AS rows FROM t), c AS (SELECT corr(attr_quantity, attr_discount) AS qd, corr(attr_quantity, attr_tax) AS qt, corr(attr_discount, attr_tax) AS dt FROM t),
k AS (SELECT unnest(['attr_quantity', 'attr_discount', 'attr_tax']) AS column_a), j AS (SELECT unnest(['attr_quantity', 'attr_discount', 'attr_tax']) AS column_b)
SELECT column_a, column_b, round(CASE WHEN column_a = column_b THEN 1 WHEN 'attr_tax' NOT IN (column_a, column_b) THEN qd WHEN 'attr_discount' NOT IN (column_a, column_b) THEN qt ELSE dt END, 6) AS r, rows, 0::BIGINT AS excluded FROM k, j, c, n""")
def attribution_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(profile.correlation_matrix(_attributed(spark, sf_dir), [f"attr_{c}" for c in _FEATURES]))


@query(f"""{_LONG}, e AS (SELECT feature, min(x) AS lo, max(x) AS hi FROM x GROUP BY 1), b AS (SELECT x.feature, least(floor((x - lo) * 20 / (hi - lo)), 19)::BIGINT AS bin, x, a FROM x JOIN e ON x.feature = e.feature)
SELECT feature, bin, count(*) AS n, round(avg(x), 4) AS mean_value, round(avg(a), 4) AS mean_attribution FROM b GROUP BY 1, 2""")
def dependence_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(evaluate.dependence(_attributed(spark, sf_dir), _FEATURES), 4)
