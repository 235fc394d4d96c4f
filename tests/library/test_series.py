"""Windows, differences, correlograms: value tests on small tables, round trips, no use of the future."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkseries.operators import correlogram, difference, evaluate, folds, unitroot, windows


def column(df, name, order):
    return [r[name] for r in df.orderBy(*order).collect()]


@pytest.fixture
def panel(spark):
    rows = [("A" if i % 2 == 0 else "B", i // 2, float(50 + 0.5 * (i // 2) + 5 * math.sin(2 * math.pi * (i // 2) / 7)) + (100 if i % 2 else 0)) for i in range(80)]
    return spark.createDataFrame(rows, "s string, t long, x double")


def test_lags_stay_within_series(spark):
    df = spark.createDataFrame([("A", 0, 1.0), ("B", 1, 100.0), ("A", 2, 2.0), ("B", 3, 200.0), ("A", 4, 4.0), ("B", 5, 400.0)], "s string, t long, x double")
    assert column(windows.LagFeatures("x", [1], "t", "s").transform(df), "x_lag_1", ["t"]) == [None, None, 1.0, 100.0, 2.0, 200.0]
    with pytest.raises(ValueError):
        windows.LagFeatures("x", [0], "t", "s")


def test_moving_average_waits_for_enough_values(spark):
    df = spark.createDataFrame([(0, 1.0), (1, None), (2, 3.0), (3, 5.0)], "t long, x double")
    assert column(windows.MovingAverage("x", 2, "t").transform(df), "x_ma_2", ["t"]) == [None, None, None, 4.0]
    assert column(windows.MovingAverage("x", 2, "t", min_periods=1).transform(df), "x_ma_2", ["t"]) == [1.0, 1.0, 3.0, 4.0]


def test_rate_of_change_and_back(spark):
    df = spark.createDataFrame([(0, 2.0), (1, 0.0), (2, 5.0), (3, 10.0)], "t long, x double")
    step = windows.RateOfChange("x", "t")
    assert column(step.transform(df), "x_roc_1", ["t"]) == [None, -1.0, None, 1.0]
    up = spark.createDataFrame([(0, 10.0), (1, 11.0), (2, 22.0)], "t long, x double")
    assert column(step.inverse_transform(step.transform(up).drop("x"), 10.0), "x", ["t"]) == pytest.approx([10, 11, 22])


def test_difference_example_and_continuation(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 3.0), (2, 6.0), (3, 10.0)], "t long, x double")
    model = difference.Difference("x", "t").fit(df)
    d = model.transform(df)
    assert column(d, "x", ["t"]) == [None, 2.0, 3.0, 4.0]
    assert column(model.inverse_transform(d), "x", ["t"]) == [1.0, 3.0, 6.0, 10.0]
    later = spark.createDataFrame([(4, 5.0), (5, 5.0)], "t long, x double")
    assert column(model.inverse_transform(later, "fit"), "x", ["t"]) == [15.0, 20.0]
    assert column(model.inverse_transform(later, df), "x", ["t"]) == [15.0, 20.0]


@pytest.mark.parametrize("kind", list(difference.KINDS))
def test_difference_round_trip(panel, kind):
    model = difference.make_difference(kind, "x", "t", "s", season=7).fit(panel)
    back = model.inverse_transform(model.transform(panel))
    assert column(back, "x", ["s", "t"]) == pytest.approx(column(panel, "x", ["s", "t"]))


def test_a_null_difference_spoils_its_phase_only(panel):
    model = difference.Difference("x", "t", "s", 7).fit(panel)
    broken = model.transform(panel).withColumn("x", F.when(~((F.col("s") == "A") & (F.col("t") == 10)), F.col("x")))
    back = model.inverse_transform(broken)
    lost = {(r.s, r.t) for r in back.collect() if r.x is None}
    assert lost == {("A", t) for t in range(10, 40, 7)}


def test_logarithm_of_what_is_not_positive_is_refused(spark):
    with pytest.raises(ValueError):
        difference.make_difference("log", "x", "t").fit(spark.createDataFrame([(0, 0.0)], "t long, x double"))
    short = spark.createDataFrame([(0, 1.0)], "t long, x double")
    with pytest.raises(ValueError):
        difference.Difference("x", "t", (), 7).fit(short).inverse_transform(short, "fit")


def test_features_do_not_read_the_target_they_predict(panel):
    step = windows.TargetHistory("x", "t", "s", [1, 2], [3], True)
    changed = panel.withColumn("x", F.when(F.col("t") == 20, F.lit(-1e9)).otherwise(F.col("x")))
    a = {(r.s, r.t): r for r in step.transform(panel).collect()}
    b = {(r.s, r.t): r for r in step.transform(changed).collect()}
    for key, row in a.items():
        if key[1] <= 20:
            assert [row[n] for n in step.names] == [b[key][n] for n in step.names]


def test_decimation_keeps_peaks(spark):
    rows = [(i, 100.0 if i == 500 else math.sin(i / 10)) for i in range(1000)]
    df = spark.createDataFrame(rows, "t long, v double")
    out = windows.decimate(df, "t", "v", 100).collect()
    assert len(out) <= 100 and max(r.v for r in out) == 100 and min(r.v for r in out) == min(v for _, v in rows)
    assert windows.decimate(df, "t", "v", 2000).count() == 1000


def test_nearest_value(spark):
    from datetime import datetime

    hour = lambda h, m=0: datetime(2020, 1, 1, h, m)
    df = spark.createDataFrame([(hour(0), 0.0), (hour(1), 1.0), (hour(2), None), (hour(4), 4.0)], "t timestamp_ntz, v double")
    probes = spark.createDataFrame([(hour(0, 20),), (hour(0, 40),), (hour(0, 30),), (hour(2),), (datetime(2030, 1, 1),)], "p timestamp_ntz")
    got = {r.p: r.nearest_time for r in windows.nearest_value(df, probes, "t", "v", "p").collect()}
    assert got == {hour(0, 20): hour(0), hour(0, 40): hour(1), hour(0, 30): hour(0), hour(2): hour(1), datetime(2030, 1, 1): hour(4)}


def test_interpolation_example(spark):
    df = spark.createDataFrame(list(enumerate([1000.0, 7679.0, 1010.0, -3.0])), "t long, p double")
    assert column(windows.interpolate(df, "p", F.col("p").between(950, 1050), "t"), "p", ["t"]) == [1000.0, 1005.0, 1010.0, 1010.0]


def test_acf_equals_a_loop_and_pacf_of_ar1(spark):
    rng = np.random.default_rng(0)
    x = [0.0]
    for _ in range(399):
        x.append(0.8 * x[-1] + rng.normal())
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "t long, x double")
    d = np.array(x) - np.mean(x)
    want = [float(d[k:] @ d[: len(d) - k]) / float(d @ d) for k in range(21)]
    assert column(correlogram.acf(df, "x", "t", nlags=20), "acf", ["lag"]) == pytest.approx(want)
    p = column(correlogram.pacf(df, "x", "t", nlags=5), "pacf", ["lag"])
    assert p[1] == pytest.approx(want[1]) and p[2] == pytest.approx((want[2] - want[1] ** 2) / (1 - want[1] ** 2)) and abs(p[3]) < 0.15
    assert correlogram.acf(df.limit(5), "x", "t").count() == 0


def test_chi_squared_tails():
    for x, k, p in ((3.841459, 1, 0.05), (5.991465, 2, 0.05), (18.307038, 10, 0.05), (24.995790, 15, 0.05), (6.634897, 1, 0.01)):
        assert correlogram.chi2_tail(x, k) == pytest.approx(p, abs=1e-6)


def test_verdicts(spark):
    rng = np.random.default_rng(3)
    noise = rng.normal(size=400)
    rows = [("noise", i, float(v)) for i, v in enumerate(noise)] + [("walk", i, float(v)) for i, v in enumerate(np.cumsum(rng.normal(size=400)))]
    df = spark.createDataFrame(rows, "s string, t long, x double")
    got = {r.s: r.verdict for r in unitroot.unit_root(df, "x", "t", "s").collect()}
    assert got["noise"] == "stationary" and got["walk"] == "unit root"
    lb = {r.s: r.p_value for r in correlogram.ljung_box(df, "x", "t", "s").collect()}
    assert lb["noise"] > 0.01 and lb["walk"] < 1e-6


def test_leverage_equals_the_hat_matrix(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 2))
    x = np.column_stack([x, x[:, 0] * 2 + 1])  # collinear
    e = rng.normal(size=60)
    df = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, e, strict=True))], "i long, a double, b double, c double, e double")
    design = np.column_stack([np.ones(60), x])
    h = np.diag(design @ np.linalg.pinv(design.T @ design) @ design.T)
    got = correlogram.influence(df, ["a", "b", "c"], "e").orderBy("i").collect()
    assert [r.leverage for r in got] == pytest.approx(h.tolist())
    s2 = float(e @ e) / (60 - 3)
    r = e / np.sqrt(s2 * (1 - h))
    assert [r_.cooks_distance for r_ in got] == pytest.approx((r**2 * h / ((1 - h) * 3)).tolist())


def test_global_index_is_the_order(spark):
    df = spark.range(0, 500).select((F.pmod(F.col("id") * 7919, F.lit(501))).alias("k"))
    assert column(folds.global_index(df, ["k"], "i"), "i", ["k"]) == list(range(500))


@pytest.mark.parametrize("size", [7, 50, 1000])
def test_chunks_of_one_long_series(spark, size):
    from sparkseries.operators import longseries

    rng = np.random.default_rng(4)
    x = rng.normal(size=300).round(3)
    df = spark.createDataFrame([(i * 3 % 301, float(x[i * 3 % 301 - 1])) for i in range(1, 301)], "t long, x double")
    plain = windows.MovingAverage("x", 5, "t").transform(windows.LagFeatures("x", [1, 6], "t").transform(df))
    chunked = longseries.by_chunks(df, ["t"], 6, lambda rows, order, series: windows.MovingAverage("x", 5, order, series).transform(windows.LagFeatures("x", [1, 6], order, series).transform(rows)), size)
    for name in ("x_lag_1", "x_lag_6", "x_ma_5"):
        a, b = column(plain, name, ["t"]), column(chunked, name, ["t"])
        assert [v is None for v in a] == [v is None for v in b] and [v for v in a if v is not None] == pytest.approx([v for v in b if v is not None])
    in_order = [v for _, v in sorted((r.t, r.x) for r in df.collect())]
    assert column(longseries.running_sum(df, ["t"], "x", "s", size), "s", ["t"]) == pytest.approx(np.cumsum(in_order).tolist())
    near_one = df.withColumn("x", 1 + F.col("x") / 1000)
    assert column(longseries.running_product(near_one, ["t"], "x", "s", size), "s", ["t"]) == pytest.approx(np.cumprod([1 + v / 1000 for v in in_order]).tolist())


def test_feature_plans_have_no_python_and_no_products(panel):
    for step in (windows.LagFeatures("x", [1], "t", "s"), windows.MovingAverage("x", 3, "t", "s"), windows.RateOfChange("x", "t", "s"), difference.Difference("x", "t", "s").fit(panel)):
        plan = step.transform(panel)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "Python" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_residual_bands_know_the_width_of_every_series(spark, monkeypatch):
    rows = [(s, t, None if t % 11 == 3 else float((t * t) % 17), t // 100) for s, n in (("a", 30), ("b", 170), ("c", 200), ("d", 263)) for t in range(n)]
    df = spark.createDataFrame(rows, "s string, t long, e double, fold long")
    limit = type(df).limit
    monkeypatch.setattr(type(df), "limit", lambda self, n: limit(self, 1))  # no list of widths, however many there are
    got = {(r.s, r.t): r.rolling for r in evaluate.residual_bands(df, "e", "t", "s", "fold").collect()}
    sizes = {s: sum(r[0] == s for r in rows) for s in "abcd"}
    assert len(got) == len(rows)
    for s, t, _, fold in rows:
        w = max(7, sizes[s] // 20)
        near = [e for s2, t2, e, f in rows if s2 == s and f == fold and t - w < t2 <= t and e is not None]
        want = sum(near) / len(near) if len(near) >= w // 2 else None
        assert got[s, t] == (want if want is None else pytest.approx(want))
