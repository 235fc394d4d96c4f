"""Profiles, reshaping, joins, features."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import categorical, dates, joins, numeric, profile, reshape
from ..operators.folds import global_index
from ..operators.ranges import shared_folder
from ..sources import files
from .registry import DAILY_SQL, daily, events, query, read, tidy


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size", "p_retailprice")


# -- numeric -----------------------------------------------------------------------------------------------------


@query("""SELECT p_partkey, round(ln(p_retailprice + 1) / ln(10), 6) AS log10, round(1.0::DOUBLE / nullif(p_size, 0), 6) AS reciprocal, round(sqrt(p_size::DOUBLE), 6) AS root, round(pow(p_size::DOUBLE, 1.5), 4) AS power,
 round(p_retailprice, 4) AS back FROM part""")
def numeric_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parts(spark, sf_dir).select("p_partkey", F.col("p_retailprice").alias("log10"), F.col("p_size").alias("reciprocal"), F.col("p_size").alias("root"), F.col("p_size").alias("power"), F.col("p_retailprice").alias("back"))
    log = numeric.Logarithm("log10", 10, 1.0)
    for step in (log, numeric.Reciprocal("reciprocal"), numeric.SquareRoot("root"), numeric.Power("power", 1.5)):
        rows = step.transform(rows)
    back = numeric.Logarithm("back", 10, 1.0)
    rows = back.inverse_transform(back.transform(rows))
    return tidy(rows.select("p_partkey", "log10", "reciprocal", "root", F.round("power", 4).alias("power"), F.round("back", 4).alias("back")))


@query("""WITH s AS (SELECT min(p_retailprice) AS a, max(p_retailprice) AS b, avg(p_retailprice) AS m, max(abs(p_retailprice)) AS x, quantile_cont(p_retailprice, 0.5) AS q2, quantile_cont(p_retailprice, 0.25) AS q1, quantile_cont(p_retailprice, 0.75) AS q3 FROM part)
SELECT p_partkey, round((p_retailprice - a) / (b - a), 6) AS minmax, round((p_retailprice - q2) / (q3 - q1), 6) AS robust, round((p_retailprice - m) / (b - a), 6) AS mean_norm, round(p_retailprice / x, 6) AS max_abs FROM part, s""")
def scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parts(spark, sf_dir).select("p_partkey", *[F.col("p_retailprice").alias(c) for c in ("minmax", "robust", "mean_norm", "max_abs")])
    for step in (numeric.MinMaxScaler("minmax"), numeric.RobustScaler("robust"), numeric.MeanNormalizer("mean_norm"), numeric.MaxAbsScaler("max_abs")):
        rows = step.fit(rows).transform(rows)
    return tidy(rows)


@query("""WITH f AS (SELECT p_partkey, CASE WHEN p_size % 7 <> 0 THEN p_size::DOUBLE END AS x FROM part), m AS (SELECT median(x) AS q FROM f), g AS (SELECT p_partkey, coalesce(x, q) AS x FROM f, m)
SELECT p_partkey, round((x - (SELECT avg(x) FROM g)) / (SELECT stddev_pop(x) FROM g), 6) AS x FROM g""")
def median_impute_standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parts(spark, sf_dir).select("p_partkey", F.when(F.col("p_size") % 7 != 0, F.col("p_size").cast("double")).alias("x"))
    return tidy(numeric.StandardImputer("x").fit(rows).transform(rows))


@query()
def power_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("box_cox"), F.col("l_extendedprice").alias("yeo_johnson"))
    rows = numeric.PowerTransformer("box_cox", "box-cox").fit(rows).transform(rows)
    return tidy(numeric.PowerTransformer("yeo_johnson").fit(rows).transform(rows))


# -- categories --------------------------------------------------------------------------------------------------


@query("""SELECT o_orderkey, """ + ", ".join(f"(o_orderpriority = '{p}')::INT::DOUBLE AS \"o_orderpriority_{p}\"" for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")) + " FROM orders")
def onehot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return categorical.OneHotEncoder("o_orderpriority").fit(rows).transform(rows).drop("o_orderpriority")


@query("WITH c AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS k FROM (SELECT DISTINCT p_brand FROM part) d) SELECT p_partkey, k::DOUBLE AS p_brand FROM part JOIN c ON part.p_brand = c.p_brand")
def ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parts(spark, sf_dir).select("p_partkey", "p_brand")
    return categorical.OrdinalEncoder("p_brand").fit(rows).transform(rows)


@query("WITH c AS (SELECT p_brand, row_number() OVER (ORDER BY avg(p_retailprice), p_brand) - 1 AS k FROM part GROUP BY 1) SELECT p_partkey, k::DOUBLE AS p_brand FROM part JOIN c ON part.p_brand = c.p_brand")
def target_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parts(spark, sf_dir)
    return categorical.TargetOrdinalEncoder("p_brand", "p_retailprice").fit(rows).transform(rows).select("p_partkey", "p_brand")


@query("""WITH t AS (SELECT * FROM part WHERE p_partkey % 5 <> 0 AND p_brand <> 'Brand#11'), g AS (SELECT avg(p_retailprice) AS m FROM t), c AS (SELECT p_brand, sum(p_retailprice) AS s, count(*) AS n FROM t GROUP BY 1)
SELECT p_partkey, round(coalesce((s + 10 * m) / (n + 10), m), 4) AS p_brand FROM part LEFT JOIN c ON part.p_brand = c.p_brand, g""")
def target_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learnt on a part of the rows; a brand that was not seen gets the mean."""
    rows = _parts(spark, sf_dir)
    train = rows.filter((F.col("p_partkey") % 5 != 0) & (F.col("p_brand") != "Brand#11"))
    return tidy(categorical.TargetEncoder("p_brand", "p_retailprice", 10.0).fit(train).transform(rows).select("p_partkey", "p_brand"), 4)


@query("""WITH f AS (SELECT *, p_partkey % 5 AS fold FROM part), c AS (SELECT p_brand, fold, sum(p_retailprice) AS s, count(*) AS n FROM f GROUP BY 1, 2),
o AS (SELECT p_brand, fold, sum(s) OVER (PARTITION BY p_brand) - s AS s, sum(n) OVER (PARTITION BY p_brand) - n AS n FROM c),
g AS (SELECT fold, (SELECT avg(p_retailprice) FROM f f2 WHERE f2.fold <> d.fold) AS m FROM (SELECT DISTINCT fold FROM f) d)
SELECT p_partkey, round(coalesce((s + 3.7::DOUBLE * m) / (n + 3.7::DOUBLE), m), 5) AS p_brand FROM f JOIN o ON f.p_brand = o.p_brand AND f.fold = o.fold JOIN g ON g.fold = f.fold""")
def target_encode_crossfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parts(spark, sf_dir).withColumn("fold", F.col("p_partkey") % 5)
    return tidy(categorical.TargetEncoder("p_brand", "p_retailprice", 3.7).fit_transform(rows, "fold").select("p_partkey", "p_brand"), 5)


@query("WITH c AS (SELECT p_size, count(*) AS n FROM part GROUP BY 1), t AS (SELECT count(*) AS t FROM part) SELECT p_partkey, CASE WHEN n >= 0.02 * t THEN part.p_size::VARCHAR ELSE 'Other' END AS p_size FROM part JOIN c ON part.p_size = c.p_size, t")
def rare_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parts(spark, sf_dir).select("p_partkey", F.col("p_size").cast("string").alias("p_size"))
    return categorical.RareGrouper("p_size", min_ratio=0.02).fit(rows).transform(rows)


# -- dates -------------------------------------------------------------------------------------------------------


@query("""SELECT event_id, year(ts) AS ts_year, month(ts) AS ts_month, day(ts) AS ts_day, isodow(ts) AS ts_weekday, week(ts) AS ts_week, hour(ts) AS ts_hour, minute(ts) AS ts_minute, second(ts) AS ts_second FROM events""")
def date_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dates.DateParts("ts", list(dates.PARTS)).transform(events(spark, sf_dir)).drop("ts", "user_id", "event_type", "value")


@query("SELECT event_id, round(epoch_us(ts - (SELECT min(ts) FROM events)) / 1e6::DOUBLE / 86400, 6) AS ts_elapsed FROM events")
def elapsed_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("event_id", "ts")
    return tidy(dates.ElapsedTime("ts").fit(rows).transform(rows).drop("ts"))


@query("SELECT event_id, round(sin(hour(ts) * 2 * pi() / 24) + 0.0, 6) + 0.0 AS hour_sin, round(cos(hour(ts) * 2 * pi() / 24), 6) + 0.0 AS hour_cos FROM events")
def cyclical(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("event_id", F.hour("ts").alias("hour"))
    return tidy(dates.Cyclical("hour", 24).transform(rows).drop("hour"))


# -- profiles ----------------------------------------------------------------------------------------------------


@query("""WITH e AS (SELECT event_type, user_id % 10 AS u, CASE WHEN value > 50 THEN round(value) END AS v FROM events), d AS (SELECT count(*) AS d FROM (SELECT DISTINCT * FROM e) x)
SELECT 'events' AS name, count(*) AS n_rows, 3::BIGINT AS n_columns, count(*) - max(d) AS duplicated_rows, round((count(*) - max(d)) / count(*)::DOUBLE, 6) AS duplicated_rate,
 (CASE WHEN count(*) > count(v) THEN 1 ELSE 0 END)::BIGINT AS missing_columns, count(*) - count(v) AS missing_cells, round((count(*) - count(v)) / (3.0::DOUBLE * count(*)), 6) AS missing_rate FROM e, d""")
def table_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("event_type", (F.col("user_id") % 10).alias("u"), F.when(F.col("value") > 50, F.round("value")).alias("v"))
    return tidy(profile.table_profile(rows, "events"))


_PROFILE = """SELECT '{c}' AS "column", '{t}' AS dtype, count(*) - count({c}) AS missing, round((count(*) - count({c})) / count(*)::DOUBLE, 6) AS missing_rate,
 count(DISTINCT {c}) + max(({c} IS NULL)::INT) AS n_unique, round((count(DISTINCT {c}) + max(({c} IS NULL)::INT)) / count(*)::DOUBLE, 6) AS unique_rate,
 (SELECT {c}::VARCHAR FROM e WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS mode,
 round((SELECT count(*) FROM e WHERE {c} IS NOT NULL GROUP BY {c}::VARCHAR ORDER BY count(*) DESC, {c}::VARCHAR LIMIT 1) / count({c})::DOUBLE, 6) AS mode_rate, {s} FROM e"""
_NUMBERS = """round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, round(min({c})::DOUBLE, 6) AS min, round(quantile_cont({c}::DOUBLE, 0.25), 6) AS p25, round(quantile_cont({c}::DOUBLE, 0.5), 6) AS median, round(quantile_cont({c}::DOUBLE, 0.75), 6) AS p75, round(max({c})::DOUBLE, 6) AS max,
 round((SELECT avg(pow({c} - (SELECT avg({c}) FROM e), 3)) FROM e) / pow(var_pop({c}), 1.5), 4) AS skewness"""
_NO_NUMBERS = ", ".join(f"NULL::DOUBLE AS {n}" for n in ("mean", "std", "min", "p25", "median", "p75", "max", "skewness"))


@query("WITH e AS (SELECT event_type, user_id, CASE WHEN value > 50 THEN value END AS value FROM events) " + " UNION ALL ".join(_PROFILE.format(c=c, t=t, s=_NUMBERS.format(c=c) if n else _NO_NUMBERS) for c, t, n in (("event_type", "string", False), ("user_id", "bigint", True), ("value", "double", True))))
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("event_type", "user_id", F.when(F.col("value") > 50, F.col("value")).alias("value"))
    return tidy(profile.column_profile(rows).withColumn("skewness", F.round("skewness", 4)))


@query("SELECT * FROM (SELECT 'event_type' AS \"column\", 0.0::DOUBLE AS missing_rate UNION ALL SELECT 'value', round((SELECT count(*) FROM events WHERE value <= 50) / count(*)::DOUBLE, 6) FROM events) x")
def missing_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(profile.missing_ranking(events(spark, sf_dir).select("event_type", F.when(F.col("value") > 50, F.col("value")).alias("value"))))


@query("""WITH e AS (SELECT min(value) AS a, max(value) AS b FROM events), x AS (SELECT least(floor((value - a) / ((b - a) / 50)), 49)::BIGINT AS bin, a, b FROM events, e)
SELECT 'value' AS "column", bin, round(a + bin * ((b - a) / 50), 6) AS low, round(a + (bin + 1) * ((b - a) / 50), 6) AS high, count(*) AS n FROM x GROUP BY bin, a, b""")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(profile.histogram(events(spark, sf_dir), ["value"]))


@query("""WITH l AS (SELECT 'p_brand' AS "column", p_brand AS value FROM part UNION ALL SELECT 'p_type', p_type FROM part UNION ALL SELECT 'p_name', p_name FROM part), c AS (SELECT "column", value, count(*) AS n FROM l GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rank FROM c) SELECT * FROM r WHERE rank <= 15""")
def top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.top_values(read(spark, sf_dir, "part").select("p_name", "p_brand", "p_type"))


_LINE = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("WITH c AS (SELECT * FROM lineitem) " + " UNION ALL ".join(f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 6) AS r, count(*) AS rows, 0::BIGINT AS excluded FROM c" for a in _LINE for b in _LINE))
def correlation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(profile.correlation_matrix(read(spark, sf_dir, "lineitem"), list(_LINE)))


@query("""WITH e AS (SELECT least(floor((l_quantity - a) * 20 / (b - a)), 19)::BIGINT AS x, least(floor((l_extendedprice - c) * 20 / (d - c)), 19)::BIGINT AS y FROM lineitem, (SELECT min(l_quantity) a, max(l_quantity) b, min(l_extendedprice) c, max(l_extendedprice) d FROM lineitem) m)
SELECT 'l_quantity' AS column_a, 'l_extendedprice' AS column_b, x AS bin_a, y AS bin_b, count(*) AS n FROM e GROUP BY 3, 4""")
def pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.pair_counts(read(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"])


@query("""WITH d AS (SELECT o_orderdate::DATE AS day, count(*) AS n FROM orders GROUP BY 1) SELECT min(day)::VARCHAR AS first, max(day)::VARCHAR AS last, sum(n)::BIGINT AS n_rows, (max(day) - min(day) + 1)::BIGINT AS expected_days,
 (max(day) - min(day) + 1 - count(*))::BIGINT AS missing_days, sum(CASE WHEN n > 1 THEN n END)::BIGINT AS duplicated_rows FROM d""")
def calendar_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(profile.calendar_summary(read(spark, sf_dir, "orders"), "o_orderdate"))


@query("""WITH l AS (SELECT l_orderkey, 'l_quantity' AS variable, l_quantity AS value, 2.0::DOUBLE AS low, 48.0::DOUBLE AS high FROM lineitem UNION ALL SELECT l_orderkey, 'l_discount', l_discount, 0.01, 0.09 FROM lineitem) SELECT * FROM l WHERE value < low OR value > high""")
def out_of_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.out_of_range(read(spark, sf_dir, "lineitem"), {"l_quantity": (2, 48), "l_discount": (0.01, 0.09)}, ["l_orderkey"])


@query("SELECT year(o_orderdate) AS year, count(*) AS n_days, round(avg(CASE WHEN o_totalprice BETWEEN 1000 AND 300000 THEN o_totalprice END), 4) AS o_totalprice FROM orders GROUP BY 1")
def yearly_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(profile.yearly_means(read(spark, sf_dir, "orders"), "o_orderdate", {"o_totalprice": (1000, 300000)}), 4)


@query("""WITH r AS (SELECT month(o_orderdate) AS month, CASE WHEN o_totalprice <= 400000 THEN o_totalprice END AS v FROM orders),
q AS (SELECT month, count(v) AS n, count(*) - count(v) AS excluded, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM r GROUP BY 1)
SELECT q.month, n, excluded, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3, round(min(v) FILTER (v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 4) AS whisker_low,
 round(max(v) FILTER (v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 4) AS whisker_high, count(*) FILTER (v NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers
FROM r JOIN q ON r.month = q.month GROUP BY q.month, n, excluded, q1, median, q3""")
def monthly_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(profile.monthly_boxes(read(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice", high=400000), 4)


@query("""WITH e AS (SELECT ts, user_id, event_type FROM events) SELECT 'user_id' AS "column", count(DISTINCT user_id) AS n_values, (SELECT count(*) FROM (SELECT DISTINCT ts, user_id FROM e) x) = count(*) AS is_group FROM e HAVING count(DISTINCT user_id) <= 500
UNION ALL SELECT 'event_type', count(DISTINCT event_type), (SELECT count(*) FROM (SELECT DISTINCT ts, event_type FROM e) x) = count(*) FROM e""")
def grouping_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.grouping_column(events(spark, sf_dir).select("ts", "user_id", "event_type"))


@query("SELECT min(ts) AS first, max(ts) AS last, min(value) AS low, max(value) AS high FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-05'")
def time_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.bounds(reshape.in_range(events(spark, sf_dir).filter("event_type = 'click'").withColumn("day", F.col("ts")), "ts", "2024-01-05"), "ts", "value")


@query("SELECT ts AS time, value FROM events WHERE event_type = 'click' AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'")
def select_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = reshape.SeriesSpec("ts", "value", "event_type", "click")
    return reshape.in_range(reshape.select_series(events(spark, sf_dir), spec), "time", "2024-01-05", "2024-01-20")


@query("SELECT DISTINCT event_type AS value FROM events WHERE event_type IS NOT NULL")
def group_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.group_values(events(spark, sf_dir), "event_type")


@query("SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, max(value) AS max_value FROM events GROUP BY 1, 2")
def daily_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.daily_max(events(spark, sf_dir), "ts", "value", ["event_type"]).withColumn("day", F.col("day").cast("string"))


# -- joins and shapes --------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def join_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(joins.repeated_keys(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"]))


@query("SELECT count(*) AS rows, count(c_custkey) AS matched, count(*) - count(c_custkey) AS unmatched, round(count(c_custkey) / count(*)::DOUBLE, 6) AS rate FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON o_custkey = c_custkey")
def join_match_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    master = read(spark, sf_dir, "customer").filter("c_acctbal > 0").withColumn("hit", F.lit(1))
    return tidy(joins.match_rate(joins.master_join(read(spark, sf_dir, "orders"), master, "o_custkey", "c_custkey"), "hit"))


@query("SELECT o_orderkey, c_name, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def master_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    nations = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    rows = joins.left_join_checked(read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")), customers, ["c_custkey"])
    return joins.left_join_checked(rows.withColumnRenamed("c_nationkey", "n_nationkey"), nations, ["n_nationkey"]).select("o_orderkey", "c_name", "n_name")


@query("""WITH h AS (SELECT event_type, max(ts) AS last FROM events WHERE event_id % 3 <> 0 GROUP BY 1), f AS (SELECT event_type, min(ts) AS first FROM events WHERE event_id % 3 = 0 GROUP BY 1) SELECT h.event_type, last, first FROM h JOIN f ON h.event_type = f.event_type WHERE first <= last""")
def overlapping_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    return joins.overlapping_series(rows.filter("event_id % 3 <> 0"), rows.filter("event_id % 3 = 0"), "ts", "event_type")


@query("WITH d AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders), e AS (SELECT unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM d) SELECT day::VARCHAR AS day FROM e WHERE day NOT IN (SELECT day FROM d)")
def anti_join_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(joins.missing_days(read(spark, sf_dir, "orders"), "o_orderdate"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_discount > 0.09)")
def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey").join(read(spark, sf_dir, "lineitem").filter("l_discount > 0.09").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi")


@query("""SELECT p_partkey, 'p_size' AS variable, p_size::DOUBLE AS value FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part""")
def unpivot_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.to_long(_parts(spark, sf_dir), ["p_partkey"], ["p_size", "p_retailprice"])


@query("""SELECT l_returnflag, round(sum(CASE WHEN l_linestatus = 'O' THEN l_quantity END), 2) AS "O", round(sum(CASE WHEN l_linestatus = 'F' THEN l_quantity END), 2) AS "F" FROM lineitem GROUP BY 1""")
def pivot_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = read(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("q"))
    return tidy(reshape.to_wide(long, ["l_returnflag"], "l_linestatus", "q", ["O", "F"]), 2)


@query("SELECT c_custkey AS key, c_acctbal::DOUBLE AS amount, c_mktsegment AS segment, NULL::VARCHAR AS name FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL, s_name FROM supplier")
def union_missing_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("amount"), F.col("c_mktsegment").alias("segment"))
    b = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("int").alias("key"), F.col("s_acctbal").alias("amount"), F.col("s_name").alias("name"))
    return reshape.relaxed_union(a, b).withColumn("key", F.col("key").cast("long"))


@query("SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def distinct_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.distinct_by(events(spark, sf_dir), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("SELECT DISTINCT event_type, hour(ts) AS hour FROM events")
def distinct_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(events(spark, sf_dir).select("event_type", F.hour("ts").alias("hour")).distinct())


@query("SELECT o_orderkey, nullif(o_orderstatus, 'O') AS status, coalesce(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice BETWEEN 1000 AND 200000 ELSE o_totalprice IS NOT NULL END, false) AS valid FROM orders")
def sentinel_and_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders")
    return rows.select("o_orderkey", reshape.sentinel_to_null("o_orderstatus", "O").alias("status"), reshape.is_valid(F.col("o_orderpriority"), F.col("o_totalprice"), "1-URGENT", 1000, 200000).alias("valid"))


@query("SELECT o_orderkey FROM orders WHERE o_orderdate < (SELECT min(o_orderdate) FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01')")
def before_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders")
    return reshape.before_test(rows, rows.filter("o_orderdate >= '2000-01-01'"), "o_orderdate", ["o_orderkey"])


@query(f"WITH {DAILY_SQL} SELECT day, row_number() OVER (ORDER BY day) - 1 AS i FROM daily")
def global_row_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row numbers of one long series without a window over all of it."""
    return tidy(global_index(daily(spark, sf_dir), ["day"], "i").select("day", "i"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_k_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


# -- files ---------------------------------------------------------------------------------------------------------


def _csv_files(spark: SparkSession, sf_dir: str) -> list[str]:
    """The orders of each priority as one CSV with a header, some prices missing and some rows twice."""
    o = read(spark, sf_dir, "orders")
    rows = o.select("o_orderkey", "o_orderstatus", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_totalprice")).alias("price"), F.regexp_replace(F.lower("o_orderpriority"), "[^a-z]", "").alias("file"))
    rows = rows.unionByName(rows.filter("o_orderkey % 13 = 0"))
    folder = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    # one file at a time: a file's rows stream into one task, which would have to sort them if it dealt them to folders
    for r in rows.select("file").distinct().orderBy("file").collect():
        part = rows.filter(F.col("file").eqNullSafe(r["file"])).drop("file")
        part.repartition(1).write.option("header", True).option("nullValue", files.NULL_MARK).csv(f"{folder}/file={r['file']}")
    return [r["path"] for r in files.list_files(spark, folder, "*.csv").select("path").orderBy("path").collect()]


_FILE = "file=([a-z]+)"
_FILES_SQL = "WITH o AS (SELECT regexp_replace(lower(o_orderpriority), '[^a-z]', '', 'g') AS file, o_orderkey AS k, o_orderstatus AS s, CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice END AS price FROM orders), t AS (SELECT * FROM o UNION ALL SELECT * FROM o WHERE k % 13 = 0)"


@query(f"""{_FILES_SQL} SELECT file, count(*) AS n_rows, 3::BIGINT AS n_columns, count(*) - count(DISTINCT k) AS duplicated_rows, CASE WHEN count(price) < count(*) THEN 1 ELSE 0 END::BIGINT AS missing_columns, count(*) - count(price) AS missing_cells,
 round((count(*) - count(price)) / (3.0::DOUBLE * count(*)), 6) AS missing_rate FROM t GROUP BY 1""")
def csv_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many CSV files profiled together."""
    out = files.profile_files(spark, _csv_files(spark, sf_dir))
    return tidy(out.select(F.regexp_extract("path", _FILE, 1).alias("file"), "n_rows", "n_columns", "duplicated_rows", "missing_columns", "missing_cells", "missing_rate"))


@query(f"""{_FILES_SQL}, p AS (SELECT file, 2::BIGINT AS position, 'price' AS "column", 'number' AS kind, count(*) - count(price) AS missing, count(DISTINCT price) + CASE WHEN count(price) < count(*) THEN 1 ELSE 0 END AS n_unique, round(avg(price), 2) AS mean, round(stddev_samp(price), 2) AS std, min(price) AS min, max(price) AS max FROM t GROUP BY 1),
k AS (SELECT file, 0::BIGINT, 'o_orderkey', 'number', 0::BIGINT, count(DISTINCT k), round(avg(k), 2), round(stddev_samp(k), 2), min(k)::DOUBLE, max(k)::DOUBLE FROM t GROUP BY 1), s AS (SELECT file, 1::BIGINT, 'o_orderstatus', 'text', 0::BIGINT, count(DISTINCT s), NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE FROM t GROUP BY 1)
SELECT * FROM p UNION ALL SELECT * FROM k UNION ALL SELECT * FROM s""")
def csv_column_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = files.profile_file_columns(spark, _csv_files(spark, sf_dir))
    return tidy(out.select(F.regexp_extract("path", _FILE, 1).alias("file"), "position", "column", "kind", "missing", "n_unique", "mean", "std", "min", "max"), 2)
