"""Time-series queries."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import correlogram, difference, longseries, unitroot, windows
from .registry import BY_PRIORITY_SQL, events, panel, query, tidy

_USER = "OVER (PARTITION BY user_id ORDER BY ts, event_id)"
_SERIES = "OVER (PARTITION BY series ORDER BY day)"


@query(f"""WITH {BY_PRIORITY_SQL} SELECT series, day, total, lag(total, 1) {_SERIES} AS total_lag_1, lag(total, 7) {_SERIES} AS total_lag_7,
 round(CASE WHEN count(total) OVER w7 >= 7 THEN avg(total) OVER w7 END, 4) AS total_ma_7,
 round((total - lag(total, 1) {_SERIES}) / nullif(lag(total, 1) {_SERIES}, 0), 4) AS total_roc_1
FROM panel WINDOW w7 AS (PARTITION BY series ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""")
def flagship_daily_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily revenue per priority with lags, a week's mean and the rate of change: one shuffle, one sort for all windows."""
    rows = panel(spark, sf_dir)
    for step in (windows.LagFeatures("total", [1, 7], "day", "series"), windows.MovingAverage("total", 7, "day", "series"), windows.RateOfChange("total", "day", "series")):
        rows = step.transform(rows)
    return tidy(rows, 4)


@query(f"SELECT event_id, lag(value, 1) {_USER} AS value_lag_1, lag(value, 3) {_USER} AS value_lag_3 FROM events")
def lag_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.LagFeatures("value", [1, 3], ["ts", "event_id"], "user_id").transform(events(spark, sf_dir)).select("event_id", "value_lag_1", "value_lag_3")


@query("""SELECT event_id, round(CASE WHEN count(value) OVER w >= 5 THEN avg(value) OVER w END, 6) AS value_ma_5 FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(windows.MovingAverage("value", 5, ["ts", "event_id"], "user_id").transform(events(spark, sf_dir)).select("event_id", "value_ma_5"))


@query("""SELECT event_id, round(CASE WHEN count(v) OVER w >= 2 THEN avg(v) OVER w END, 6) AS v_ma_5 FROM (SELECT *, CASE WHEN value > 100 THEN value END AS v FROM events) e
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def moving_average_min_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("v", F.when(F.col("value") > 100, F.col("value")))
    return tidy(windows.MovingAverage("v", 5, ["ts", "event_id"], "user_id", min_periods=2).transform(rows).select("event_id", "v_ma_5"))


@query(f"SELECT event_id, round((value - lag(value, 2) {_USER}) / nullif(lag(value, 2) {_USER}, 0), 4) AS value_roc_2 FROM events")
def rate_of_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(windows.RateOfChange("value", ["ts", "event_id"], "user_id", 2).transform(events(spark, sf_dir)).select("event_id", "value_roc_2"), 4)


@query(f"""WITH {BY_PRIORITY_SQL}, f AS (SELECT *, first_value(total) {_SERIES} AS a FROM panel) SELECT series, day, round(100.0 * total / a, 2) AS total FROM f""")
def cumulative_growth_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates turned back into an index that begins at 100."""
    step = windows.RateOfChange("total", "day", "series")
    return tidy(step.inverse_transform(step.transform(panel(spark, sf_dir)), 100.0).select("series", "day", "total"), 2)


@query(f"WITH {BY_PRIORITY_SQL} SELECT series, day, round(total - lag(total, 7) {_SERIES}, 4) AS total FROM panel")
def diff_seasonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = panel(spark, sf_dir)
    return tidy(difference.make_difference("seasonal_diff", "total", "day", "series", season=7).fit(rows).transform(rows), 4)


@query(f"WITH {BY_PRIORITY_SQL} SELECT series, day, round(ln(total + 1) - lag(ln(total + 1)) {_SERIES}, 6) AS total FROM panel")
def log_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = panel(spark, sf_dir)
    return tidy(difference.make_difference("log_diff", "total", "day", "series", offset=1.0).fit(rows).transform(rows))


@query(f"WITH {BY_PRIORITY_SQL} SELECT series, day, total FROM panel")
def seasonal_inverse_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seasonal differences added up again, each phase from its anchor: the input comes back."""
    rows = panel(spark, sf_dir)
    model = difference.Difference("total", "day", "series", 7).fit(rows)
    return tidy(model.inverse_transform(model.transform(rows)), 2)


@query(f"""WITH {BY_PRIORITY_SQL}, v AS (SELECT series, day, total AS raw, CASE WHEN total > 0 THEN ln(total) END AS log FROM panel),
x AS (SELECT series, day, raw, log, raw - lag(raw) {_SERIES} AS diff, log - lag(log) {_SERIES} AS log_diff, raw - lag(raw, 7) {_SERIES} AS seasonal_diff, log - lag(log, 7) {_SERIES} AS log_seasonal_diff FROM v)
SELECT series, day, variant, round(value, 4) AS value FROM x UNPIVOT INCLUDE NULLS (value FOR variant IN (raw, log, diff, log_diff, seasonal_diff, log_seasonal_diff))""")
def six_variants_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(difference.six_variants_long(panel(spark, sf_dir), "total", "day", "series"), 4)


@query(f"""WITH {BY_PRIORITY_SQL} SELECT series, day, lag(total, 1) {_SERIES} AS total_lag_1, lag(total, 7) {_SERIES} AS total_lag_7,
 round(CASE WHEN count(total) OVER w >= 3 THEN avg(total) OVER w END, 4) AS total_lag_1_ma_3,
 round((lag(total, 1) {_SERIES} - lag(total, 2) {_SERIES}) / nullif(lag(total, 2) {_SERIES}, 0), 4) AS total_lag_1_roc_1
FROM panel WINDOW w AS (PARTITION BY series ORDER BY day ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)""")
def target_history_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(windows.TargetHistory("total", "day", "series", [1, 7], [3], True).transform(panel(spark, sf_dir)).drop("total"), 4)


@query(f"WITH {BY_PRIORITY_SQL} SELECT series, day, row_number() {_SERIES} AS step FROM panel")
def step_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(windows.step_index(panel(spark, sf_dir), "day", "series").select("series", "day", "step"))


@query(f"WITH {BY_PRIORITY_SQL} SELECT series, day, total FROM panel QUALIFY row_number() OVER (PARTITION BY series ORDER BY day DESC) <= 14")
def tail_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(windows.tail(panel(spark, sf_dir), 14, "day", "series"))


@query("""WITH e AS (SELECT *, count(*) OVER (PARTITION BY event_type) AS n, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i FROM events),
b AS (SELECT *, CASE WHEN n <= 200 THEN -1 ELSE i * 100 // n END AS bucket FROM e),
m AS (SELECT *, row_number() OVER (PARTITION BY event_type, bucket ORDER BY value, i) AS lo, row_number() OVER (PARTITION BY event_type, bucket ORDER BY value DESC, i) AS hi FROM b)
SELECT event_id, event_type, ts, value FROM m WHERE n <= 200 OR lo = 1 OR hi = 1""")
def peak_decimation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.decimate(events(spark, sf_dir), "ts", "value", 200, "event_type", ["event_id"]).select("event_id", "event_type", "ts", "value")


@query("""SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) e
WHERE i % greatest(1, n // 100) = 0""")
def systematic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.systematic_sample(events(spark, sf_dir), 100, ["ts", "event_id"], "event_type").select("event_id", "event_type")


@query("""WITH p AS (SELECT event_type, d AS probe FROM (SELECT DISTINCT event_type FROM events) t, (SELECT DISTINCT date_trunc('day', ts) + INTERVAL 6 HOUR AS d FROM events) u),
o AS (SELECT event_type, ts, max(value) AS value FROM events GROUP BY 1, 2),
c AS (SELECT p.event_type, probe, ts, value, row_number() OVER (PARTITION BY p.event_type, probe ORDER BY abs(epoch_us(ts) - epoch_us(probe)), ts) AS k FROM p JOIN o ON p.event_type = o.event_type)
SELECT event_type, probe, ts AS nearest_time, value AS nearest_value FROM c WHERE k = 1""")
def nearest_time_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).groupBy("event_type", "ts").agg(F.max("value").alias("value"))
    days = rows.select((F.date_trunc("day", "ts") + F.expr("INTERVAL 6 HOURS")).cast("timestamp_ntz").alias("probe")).distinct()
    probes = rows.select("event_type").distinct().crossJoin(F.broadcast(days))
    return windows.nearest_value(rows, probes, "ts", "value", "probe", ["event_type"])


@query(f"""WITH {BY_PRIORITY_SQL}, x AS (SELECT series, (day::DATE - DATE '1970-01-01') AS d, total FROM panel), g AS (SELECT *, d - lag(d) OVER (PARTITION BY series ORDER BY d) AS gap FROM x),
m AS (SELECT series, median(gap) FILTER (gap > 0) AS med, count(*) AS n FROM g GROUP BY 1)
SELECT g.series, g.d, CASE WHEN NOT coalesce(n >= 3 AND gap > 1.5 * med, false) THEN total END AS total FROM g JOIN m ON g.series = m.series""")
def gap_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = panel(spark, sf_dir).select("series", F.datediff("day", F.lit("1970-01-01").cast("date")).cast("long").alias("d"), "total")
    return windows.gap_breaks(rows, "d", "total", "series", 1.5).select("series", "d", "total")


@query("""WITH x AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, CASE WHEN value BETWEEN 20 AND 300 THEN value END AS v FROM events),
y AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN i END) OVER (PARTITION BY user_id ORDER BY i) AS a, min(CASE WHEN v IS NOT NULL THEN i END) OVER (PARTITION BY user_id ORDER BY i DESC) AS b FROM x),
z AS (SELECT y.*, p.v AS va, q.v AS vb FROM y LEFT JOIN x p ON p.user_id = y.user_id AND p.i = y.a LEFT JOIN x q ON q.user_id = y.user_id AND q.i = y.b)
SELECT event_id, round(CASE WHEN v IS NOT NULL THEN v ELSE coalesce(va + (vb - va) * (i - a) / nullif(b - a, 0), va, vb) END, 4) AS value FROM z""")
def linear_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(windows.interpolate(events(spark, sf_dir), "value", F.col("value").between(20, 300), ["ts", "event_id"], "user_id").select("event_id", "value"), 4)


@query("""SELECT event_id, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS block
FROM (SELECT *, CASE WHEN event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 1 ELSE 0 END AS s FROM events) e""")
def segment_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.change_blocks(events(spark, sf_dir), "event_type", ["ts", "event_id"], "user_id").select("event_id", "block")


@query(f"""WITH {BY_PRIORITY_SQL}, x AS (SELECT series, total - avg(total) OVER (PARTITION BY series) AS x, row_number() OVER (PARTITION BY series ORDER BY day) AS i, count(*) OVER (PARTITION BY series) AS n FROM panel),
s AS (SELECT series, n, sum(x * x) AS s0 FROM x GROUP BY 1, 2), k AS (SELECT unnest(range(0, 21)) AS lag),
c AS (SELECT a.series, k.lag, sum(a.x * b.x) AS s FROM x a, k, x b WHERE a.series = b.series AND b.i = a.i + k.lag GROUP BY 1, 2)
SELECT c.series, n, c.lag, round(c.s / s.s0, 6) AS acf FROM c JOIN s ON c.series = s.series WHERE n >= 10 AND c.lag < n""")
def acf_per_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(correlogram.acf(panel(spark, sf_dir), "total", "day", "series", 20))


@query(f"""WITH {BY_PRIORITY_SQL}, x AS (SELECT series, total - avg(total) OVER (PARTITION BY series) AS x, row_number() OVER (PARTITION BY series ORDER BY day) AS i, count(*) OVER (PARTITION BY series) AS n FROM panel),
s AS (SELECT series, n, sum(x * x) AS s0 FROM x GROUP BY 1, 2), k AS (SELECT unnest(range(1, 11)) AS lag),
c AS (SELECT a.series, k.lag, sum(a.x * b.x) AS s FROM x a, k, x b WHERE a.series = b.series AND b.i = a.i + k.lag GROUP BY 1, 2)
SELECT c.series, n, 10::BIGINT AS lag, round(n * (n + 2) * sum(pow(c.s / s.s0, 2) / (n - c.lag)), 4) AS q FROM c JOIN s ON c.series = s.series GROUP BY 1, 2""")
def ljung_box_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(correlogram.ljung_box(panel(spark, sf_dir), "total", "day", "series").drop("p_value"), 4)



@query("""WITH m AS (SELECT event_type, count(value) AS n, avg(value) AS m, var_pop(value) AS s2 FROM events GROUP BY 1),
c AS (SELECT e.event_type, avg(pow(value - m, 3)) AS m3, avg(pow(value - m, 4)) AS m4 FROM events e JOIN m ON e.event_type = m.event_type GROUP BY 1),
j AS (SELECT m.event_type, n, m3 / pow(s2, 1.5) AS sk, m4 / (s2 * s2) - 3 AS ku FROM m JOIN c ON m.event_type = c.event_type)
SELECT event_type, n, round(sk, 6) AS skewness, round(ku, 6) AS kurtosis, round(n / 6.0::DOUBLE * (sk * sk + ku * ku / 4.0), 4) AS jb FROM j""")
def jarque_bera(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = correlogram.jarque_bera(events(spark, sf_dir), "value", ["event_type"])
    return tidy(out.select("event_type", "n", "skewness", "kurtosis")).join(tidy(out.select("event_type", "jb"), 4), "event_type")


@query(f"""WITH RECURSIVE {BY_PRIORITY_SQL}, x AS (SELECT series, total - avg(total) OVER (PARTITION BY series) AS x, row_number() OVER (PARTITION BY series ORDER BY day) AS i, count(*) OVER (PARTITION BY series) AS n FROM panel),
s AS (SELECT series, n, sum(x * x) AS s0 FROM x GROUP BY 1, 2), k AS (SELECT unnest(range(0, 21)) AS lag),
c AS (SELECT a.series, k.lag, sum(a.x * b.x) AS s FROM x a, k, x b WHERE a.series = b.series AND b.i = a.i + k.lag GROUP BY 1, 2),
r AS (SELECT c.series, n, list(c.s / s.s0 ORDER BY c.lag) AS r FROM c JOIN s ON c.series = s.series WHERE n >= 10 AND 2 * c.lag < n GROUP BY 1, 2),
d(series, n, r, k, phi, last) AS (SELECT series, n, r, 0::BIGINT, []::DOUBLE[], 1.0::DOUBLE FROM r UNION ALL
  SELECT series, n, r, k + 1, list_append(list_transform(range(1, k + 1), lambda i: phi[i] - next * phi[k + 1 - i]), next), next
  FROM (SELECT *, (r[k + 2] - coalesce(list_sum(list_transform(range(1, k + 1), lambda i: phi[i] * r[k + 2 - i])), 0)) / (1 - coalesce(list_sum(list_transform(range(1, k + 1), lambda i: phi[i] * r[i + 1])), 0)) AS next FROM d WHERE k + 1 < len(r)) t)
SELECT series, n, k AS lag, round(last, 6) AS pacf FROM d""")
def pacf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(correlogram.pacf(panel(spark, sf_dir), "total", "day", "series", 20))


@query()
def unit_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(unitroot.unit_root(panel(spark, sf_dir), "total", "day", "series"))


@query()
def unit_root_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(unitroot.unit_root(panel(spark, sf_dir), "total", "day", "series", regression="ct"))


#: Both tests in closed form: the regression without past differences has one slope; KPSS with its automatic bandwidth, for which ``e`` are the residuals of the level or the trend.
def _unit_root_sql(trend: bool) -> str:
    residual = "v - m - b * (i - (n + 1) / 2.0::DOUBLE)" if trend else "v - m"
    # of a regression on the value before and on time, by partial correlations
    adf = "(q1 - r * q2) / sqrt((1 - r * r) * (1 - q2 * q2) - pow(q1 - r * q2, 2)) * sqrt(o - 3)" if trend else "q1 / sqrt(1 - q1 * q1) * sqrt(o - 2)"
    table = "[(0.0, 0.119, 0.1), (0.119, 0.146, 0.05), (0.146, 0.176, 0.025), (0.176, 0.216, 0.01)]" if trend else "[(0.0, 0.347, 0.1), (0.347, 0.463, 0.05), (0.463, 0.574, 0.025), (0.574, 0.739, 0.01)]"
    at = [float(x) for x in re.findall(r", (0\.\d+), ", table)]
    steps = list(zip(at, (0.1, 0.05, 0.025, 0.01), strict=True))
    cases = " ".join(f"WHEN kpss <= {b} THEN {p} + ({q} - {p}) * (kpss - {a}) / ({b} - {a})" for (a, p), (b, q) in zip(steps, steps[1:], strict=False))
    return f"""WITH {BY_PRIORITY_SQL}, x AS (SELECT series, total AS v, row_number() {_SERIES} AS i, count(*) OVER (PARTITION BY series) AS n, lag(total) {_SERIES} AS past FROM panel),
d AS (SELECT series, corr(past, v - past) AS q1, corr(i, v - past) AS q2, corr(past, i) AS r, count(past) AS o FROM x WHERE past IS NOT NULL GROUP BY 1), s AS (SELECT series, avg(v) AS m, regr_slope(v, i) AS b FROM x GROUP BY 1),
e AS (SELECT x.series, n, i, {residual} AS e FROM x JOIN s ON x.series = s.series), c AS (SELECT a.series, a.n, b.i - a.i AS k, sum(a.e * b.e) AS c FROM e a JOIN e b ON a.series = b.series AND b.i - a.i BETWEEN 0 AND 200 GROUP BY 1, 2, 3),
w AS (SELECT series, n, (sum(CASE WHEN k BETWEEN 1 AND floor(pow(n, 2 / 9.0::DOUBLE)) THEN 2 * k * c END) / sum(CASE WHEN k = 0 THEN c WHEN k <= floor(pow(n, 2 / 9.0::DOUBLE)) THEN 2 * c END)) AS s FROM c GROUP BY 1, 2),
l AS (SELECT series, n, least(n - 1, floor(1.1447::DOUBLE * pow(s * s, 1 / 3.0::DOUBLE) * pow(n, 1 / 3.0::DOUBLE)))::BIGINT AS lags FROM w),
v AS (SELECT c.series, sum(CASE WHEN k = 0 THEN c WHEN k <= lags THEN 2 * (1 - k / (lags + 1.0::DOUBLE)) * c END) / any_value(c.n) AS var FROM c JOIN l ON c.series = l.series GROUP BY 1),
u AS (SELECT series, sum(s * s) AS s2 FROM (SELECT series, sum(e) OVER (PARTITION BY series ORDER BY i) AS s FROM e) t GROUP BY 1), k AS (SELECT l.series, n, lags, s2 / (n::DOUBLE * n * var) AS kpss FROM l JOIN u ON l.series = u.series JOIN v ON l.series = v.series)
SELECT k.series, n, round({adf}, 4) AS adf, 0::BIGINT AS adf_lags, round(kpss, 6) AS kpss, round(CASE WHEN kpss <= {at[0]} THEN 0.1 {cases} ELSE 0.01 END::DOUBLE, 6) AS kpss_p, lags AS kpss_lags FROM k JOIN d ON k.series = d.series"""


def _plain_unit_root(spark: SparkSession, sf_dir: str, regression: str) -> DataFrame:
    out = unitroot.unit_root(panel(spark, sf_dir), "total", "day", "series", regression=regression, adf_lags=0)
    return tidy(out.select("series", "n", F.round("adf", 4).alias("adf"), "adf_lags", "kpss", "kpss_p", "kpss_lags"))


@query(_unit_root_sql(False))
def dickey_fuller_kpss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain_unit_root(spark, sf_dir, "c")


@query(_unit_root_sql(True))
def dickey_fuller_kpss_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain_unit_root(spark, sf_dir, "ct")


@query(f"""WITH {BY_PRIORITY_SQL}, l AS (SELECT series, day, total AS raw, CASE WHEN total > 0 THEN ln(total) END AS log FROM panel),
u AS (SELECT series, day, raw, log, raw - lag(raw) {_SERIES} AS diff, log - lag(log) {_SERIES} AS log_diff, raw - lag(raw, 7) {_SERIES} AS seasonal_diff, log - lag(log, 7) {_SERIES} AS log_seasonal_diff FROM l),
v AS (SELECT series, day, variant, value FROM u UNPIVOT (value FOR variant IN (raw, log, diff, log_diff, seasonal_diff, log_seasonal_diff))),
x AS (SELECT series, variant, value - avg(value) OVER w AS x, row_number() OVER (PARTITION BY series, variant ORDER BY day) AS i, count(*) OVER w AS n FROM v WINDOW w AS (PARTITION BY series, variant)),
s AS (SELECT series, variant, n, sum(x * x) AS s0 FROM x GROUP BY 1, 2, 3), k AS (SELECT unnest(range(0, 11)) AS lag),
c AS (SELECT a.series, a.variant, k.lag, sum(a.x * b.x) AS s FROM x a, k, x b WHERE a.series = b.series AND a.variant = b.variant AND b.i = a.i + k.lag GROUP BY 1, 2, 3)
SELECT c.series, 'total' AS "column", c.variant, n, c.lag, round(c.s / s.s0, 6) AS acf, round(1.96 / sqrt(n), 6) AS band FROM c JOIN s ON c.series = s.series AND c.variant = s.variant WHERE n >= 10 AND c.lag < n""")
def time_series_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(correlogram.series_checks(panel(spark, sf_dir), "day", ["total"], "series", 10))


@query()
def residual_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windows.LagFeatures("total", [7], "day", "series").transform(panel(spark, sf_dir)).withColumn("e", F.col("total") - F.col("total_lag_7")).filter(F.col("e").isNotNull())
    return tidy(correlogram.residual_tests(rows, "e", "day", ["series"]))


_ALL = "OVER (ORDER BY ts, event_id)"


@query(f"""SELECT event_id, lag(value, 1) {_ALL} AS value_lag_1, lag(value, 30) {_ALL} AS value_lag_30, round(CASE WHEN count(value) OVER w >= 20 THEN avg(value) OVER w END, 6) AS value_ma_20, round(sum(value) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 2) AS value_sum
FROM events WINDOW w AS (ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")
def long_series_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one series, in chunks: no window holds the table."""

    def features(rows: DataFrame, order: str, series: str) -> DataFrame:
        return windows.MovingAverage("value", 20, order, series).transform(windows.LagFeatures("value", [1, 30], order, series).transform(rows))

    size = 20_000
    rows = longseries.running_sum(events(spark, sf_dir), ["ts", "event_id"], "value", "value_sum", size)
    out = longseries.by_chunks(rows, ["ts", "event_id"], 30, features, size)
    return tidy(out.select("event_id", "value_lag_1", "value_lag_30", "value_ma_20", F.round("value_sum", 2).alias("value_sum")))
