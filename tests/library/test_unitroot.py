"""Unit-root tests from lagged sums against regressions on the whole series."""

import math

import numpy as np
import pytest

from sparkseries.operators import correlogram, unitroot


def dense_adf(x: np.ndarray, regression: str) -> tuple[float, int]:
    x = (x - x.mean()) / x.std()
    d = np.diff(x)
    most = unitroot.most_lags(len(x), regression)

    def fit(p: int, skip: int):
        y, t = d[skip:], np.arange(skip + 1, len(x)) / len(x)
        a = np.column_stack([x[skip:-1], np.ones(len(y)), *([t] if regression == "ct" else []), *(d[skip - j : len(d) - j] for j in range(1, p + 1))])
        beta, *_ = np.linalg.lstsq(a, y, rcond=None)
        return a, y, beta, float(((y - a @ beta) ** 2).sum())

    def criterion(p: int) -> float:
        _, y, _, sse = fit(p, most)
        return len(y) * math.log(sse / len(y)) + 2 * p

    best = min(range(most + 1), key=criterion)
    a, y, beta, sse = fit(best, best)
    return float(beta[0] / math.sqrt(sse / (len(y) - a.shape[1]) * np.linalg.inv(a.T @ a)[0, 0])), best


def dense_kpss(x: np.ndarray, regression: str) -> tuple[float, int]:
    n, t = len(x), np.arange(len(x))
    e = x - x.mean() if regression == "c" else x - np.polyval(np.polyfit(t, x, 1), t)
    cov = [float(e[k:] @ e[: n - k]) / n for k in range(n)]
    upto = int(n ** (2 / 9))
    s0 = cov[0] + 2 * sum(cov[1 : upto + 1])
    s1 = 2 * sum(k * cov[k] for k in range(1, upto + 1))
    lags = min(n - 1, int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)))
    long_run = cov[0] + 2 * sum((1 - k / (lags + 1)) * cov[k] for k in range(1, lags + 1))
    return float((np.cumsum(e) ** 2).sum() / (n * n * long_run)), lags


def some_series() -> dict:
    rng = np.random.default_rng(7)
    walk = np.cumsum(rng.normal(size=300))
    swing = rng.normal(size=150)
    swing[1:] -= 0.97 * swing[:-1]
    return {"noise": rng.normal(size=220), "walk": walk + 1e6, "trend": 0.3 * np.arange(160) + rng.normal(size=160), "short": rng.normal(size=20), None: np.cumsum(rng.normal(size=90)) * 1e-6, "swing": np.cumsum(swing)}


@pytest.mark.parametrize("regression,range_rows", [("c", 10**6), ("ct", 10**6), ("c", 61), ("ct", 61)])
def test_against_whole_regressions(spark, regression, range_rows):
    series = some_series()
    rows = [(k, i, float(v)) for k, x in series.items() for i, v in enumerate(x)]
    rows += [("noise", 1000, None), ("noise", 1001, math.nan), ("few", 0, 1.0), *(("flat", i, 2.0) for i in range(30))]
    df = spark.createDataFrame(rows, "s string, t long, x double").repartition(3)
    got = {r.s: r for r in unitroot.unit_root(df, "x", "t", "s", regression=regression, range_rows=range_rows).collect()}
    assert got.keys() == series.keys() | {"few", "flat"}
    for k, x in series.items():
        t, lags = dense_adf(x, regression)
        statistic, kpss_lags = dense_kpss(x, regression)
        r = got[k]
        assert (r.n, r.adf_lags, r.kpss_lags) == (len(x), lags, kpss_lags), k
        assert r.adf == pytest.approx(t, rel=1e-6) and r.kpss == pytest.approx(statistic, rel=1e-6), k
        assert r.verdict == unitroot.VERDICTS[r.adf_p < 0.05, r.kpss_p < 0.05]
    for k in ("few", "flat"):
        assert got[k].verdict == "not computed" and got[k].adf is None and got[k].kpss_lags is None
    assert got["noise"].adf_p < 0.01 < 0.05 < got["walk"].adf_p


def test_probabilities():
    for regression in ("c", "ct"):
        for level, (limit, *_) in unitroot.ADF_CRITICAL[regression].items():
            assert unitroot.adf_probability(limit, regression) == pytest.approx(level, abs=0.002)
        for p, limit in unitroot.KPSS_CRITICAL[regression].items():
            assert unitroot.kpss_probability(limit, regression) == pytest.approx(p)
        assert unitroot.adf_probability(-30, regression) == 0 and unitroot.adf_probability(3, regression) == 1
        assert unitroot.kpss_probability(0, regression) == 0.1 and unitroot.kpss_probability(9, regression) == 0.01


def test_one_series_and_none(spark):
    x = some_series()["noise"]
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "t long, x double")
    (r,) = unitroot.unit_root(df, "x", "t").collect()
    assert r.series == "all" and r.adf == pytest.approx(dense_adf(x, "c")[0])
    assert unitroot.unit_root(df.filter("t < 0"), "x", "t").count() == 0
    with pytest.raises(ValueError, match="regression"):
        unitroot.unit_root(df, "x", "t", regression="n")


def test_no_group_holds_a_series():
    import inspect

    assert "applyInPandas" not in inspect.getsource(unitroot)


def test_residual_verdicts(spark):
    rng = np.random.default_rng(3)
    rows = [("noise", i, float(v)) for i, v in enumerate(rng.normal(size=300))] + [("walk", i, float(v)) for i, v in enumerate(np.cumsum(rng.normal(size=300)))] + [("few", i, 1.0 * i) for i in range(5)]
    df = spark.createDataFrame(rows, "s string, t long, x double")
    got = {r.s: r for r in correlogram.residual_tests(df, "x", "t", ["s"], period=12, lags=None).collect()}
    assert (got["noise"].autocorrelation, got["noise"].stationarity, got["noise"].lb_lag) == ("not found", "stationary", 12)
    assert (got["walk"].autocorrelation, got["walk"].stationarity) == ("found", "unit root")
    assert (got["few"].autocorrelation, got["few"].stationarity) == ("not computed", "not computed")
    table = correlogram.ljung_box(df, "x", "t", ["s"], period=12).collect()
    assert sorted((r.s, r.lag) for r in table) == [("noise", 10), ("noise", 12), ("walk", 10), ("walk", 12)]
    less = {r.s: r.lb_p for r in correlogram.residual_tests(df, "x", "t", ["s"], model_df=3).collect()}
    assert less["noise"] != got["noise"].lb_p
