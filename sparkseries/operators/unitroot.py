"""Unit-root tests of many series, each of any length: lagged products are sums over all rows, and what remains per series is a small matrix."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import is_finite
from .base import as_list
from .ranges import RANGE_ROWS, along, with_past, written

#: MacKinnon's (2010) critical values and (1994) probabilities of the statistic with a constant (c) or with a trend too (ct), and the KPSS (1992) tables (fixed values).
ADF_CRITICAL = {
    "c": {0.01: (-3.43035, -6.5393, -16.786, -79.433), 0.05: (-2.86154, -2.8903, -4.234, -40.040), 0.10: (-2.56677, -1.5384, -2.809, 0.0)},
    "ct": {0.01: (-3.95877, -9.0531, -28.428, -134.155), 0.05: (-3.41049, -4.3904, -9.036, -45.374), 0.10: (-3.12705, -2.5856, -3.925, -22.380)},
}
ADF_PROBABILITY = {
    "c": {"least": -18.83, "turn": -1.61, "most": 2.74, "small": (2.1659, 1.4412, 0.038269), "large": (1.7339, 0.93202, -0.12745, -0.010368)},
    "ct": {"least": -16.18, "turn": -2.89, "most": 0.70, "small": (3.2512, 1.6047, 0.049588), "large": (2.5261, 0.61654, -0.37956, -0.060285)},
}
KPSS_CRITICAL = {"c": {0.10: 0.347, 0.05: 0.463, 0.025: 0.574, 0.01: 0.739}, "ct": {0.10: 0.119, 0.05: 0.146, 0.025: 0.176, 0.01: 0.216}}
LEAST_ROWS = 20
VERDICTS = {(True, False): "stationary", (False, True): "unit root", (True, True): "difference stationary", (False, False): "inconclusive"}


def adf_probability(t: float, regression: str) -> float:
    """The probability of a lower statistic under a unit root."""
    table = ADF_PROBABILITY[regression]
    if t > table["most"]:
        return 1.0
    if t < table["least"]:
        return 0.0
    z = sum(c * t**k for k, c in enumerate(table["small" if t <= table["turn"] else "large"]))
    return 0.5 * math.erfc(-z / math.sqrt(2))


def kpss_probability(x: float, regression: str) -> float:
    """Interpolated in the table, and no less than 0.01 or more than 0.1."""
    table = sorted((v, p) for p, v in KPSS_CRITICAL[regression].items())
    return float(np.interp(x, [v for v, _ in table], [p for _, p in table]))


def most_lags(n: int, regression: str) -> int:
    """The most differences in the past that the Dickey-Fuller regression of n values may use."""
    return max(0, min(n // 2 - len(regression) - 1, math.ceil(12 * (n / 100) ** 0.25)))


def _bandwidth_lags(n: int) -> int:
    return int(n ** (2 / 9))


class LagSums:
    """What the regressions of one series need: sums over all its rows, and its first and last values, for the edges.

    With d_t = x_t - x_(t-1): ``c[k]`` sums d_t d_(t-k), ``d[j]`` sums x_(t-1) d_(t-j), ``x1``, ``x2`` and ``xt`` sum x_(t-1), its square and t x_(t-1), and ``dt`` sums t d_t, over all t where these exist.
    """

    def __init__(self, n: int, c, d, x1: float, x2: float, xt: float, dt: float, head, tail):
        self.n, self.c, self.d, self.x1, self.x2, self.xt, self.dt = n, np.asarray(c), np.asarray(d), x1, x2, xt, dt
        self.head, self.tail = np.asarray(head), np.asarray(tail)

    def x(self, t: int) -> float:
        return float(self.head[t] if t < len(self.head) else self.tail[t - self.n + len(self.tail)])

    def diff(self, t: int) -> float:
        return self.x(t) - self.x(t - 1)

    def gram(self, lags: int, begin: int, trend: bool) -> np.ndarray:
        """Sums of products over t >= begin of: x_(t-1), 1, t / n (with a trend), d_(t-1) .. d_(t-lags), and last d_t."""
        n, s, m = self.n, begin, 2 + trend
        size = m + lags + 1
        g = np.zeros((size, size))
        early = range(1, s)
        g[0, 0] = self.x2 - sum(self.x(t - 1) ** 2 for t in early)
        g[0, 1] = self.x1 - sum(self.x(t - 1) for t in early)
        g[1, 1] = n - s
        if trend:
            ts = lambda upto, power: sum(t**power for t in range(1, upto)) if upto < 64 else (upto * (upto - 1) // 2 if power == 1 else (upto - 1) * upto * (2 * upto - 1) // 6)
            g[0, 2] = (self.xt - sum(t * self.x(t - 1) for t in early)) / n
            g[1, 2] = (ts(n, 1) - ts(s, 1)) / n
            g[2, 2] = (ts(n, 2) - ts(s, 2)) / n / n
        place = lambda j: size - 1 if j == 0 else m + j - 1
        # edges of the lagged products, as running sums of the first and the last ones
        for j in range(lags + 1):
            g[0, place(j)] = self.d[j] - sum(self.x(t - 1) * self.diff(t - j) for t in range(j + 1, s))
            g[1, place(j)] = self.x(n - 1 - j) - self.x(s - 1 - j)
            if trend:
                inside = self.dt - sum(u * self.diff(u) for u in range(1, s - j)) - sum(u * self.diff(u) for u in range(n - j, n))
                g[2, place(j)] = (inside + j * g[1, place(j)]) / n
        for k in range(lags + 1):
            first = np.concatenate([[0.0], np.cumsum([self.diff(u) * self.diff(u - k) for u in range(k + 1, s)])])
            last = np.concatenate([[0.0], np.cumsum([self.diff(u) * self.diff(u - k) for u in range(n - 1, n - 1 - lags + k, -1)])])
            for i in range(lags + 1 - k):
                a, b = place(i), place(i + k)
                g[min(a, b), max(a, b)] = self.c[k] - first[max(0, s - i - 1 - k)] - last[i]
        return g + np.triu(g, 1).T


def adf_from_sums(sums: LagSums, regression: str, fixed: int | None = None) -> tuple[float, int, int]:
    """The augmented Dickey-Fuller t statistic, lags by Akaike's criterion on one common sample (or ``fixed``): statistic, lags, observations.

    One factor of the largest matrix has those of all smaller numbers of lags as its leading parts.
    """
    trend = regression == "ct"
    m, most = 2 + trend, most_lags(sums.n, regression) if fixed is None else fixed
    g = sums.gram(most, most + 1, trend)
    used = sums.n - most - 1
    try:
        z = np.linalg.solve(np.linalg.cholesky(g[:-1, :-1]), g[:-1, -1])
        explained = np.cumsum(z * z)
        sse = [g[-1, -1] - explained[m + p - 1] for p in range(most + 1)]
    except np.linalg.LinAlgError:
        sse = [g[-1, -1] - g[: m + p, -1] @ np.linalg.lstsq(g[: m + p, : m + p], g[: m + p, -1], rcond=None)[0] for p in range(most + 1)]
    best = most if fixed is not None else min(range(most + 1), key=lambda p: used * math.log(max(sse[p], 1e-300) / used) + 2 * p)
    g = sums.gram(best, best + 1, trend)
    a, y = g[:-1, :-1], g[:-1, -1]
    inverse = np.linalg.pinv(a, rcond=1e-13, hermitian=True)
    beta = inverse @ y
    used = sums.n - best - 1
    variance = (g[-1, -1] - y @ beta) / max(1, used - len(a)) * inverse[0, 0]
    return (float(beta[0] / math.sqrt(variance)) if variance > 0 else float("nan")), best, used


def kpss_lags(products: Sequence[float], n: int) -> int:
    """The automatic bandwidth of Hobijn, Franses and Ooms from the sums of lagged products."""
    s0, s1 = products[0] / n, 0.0
    for k in range(1, _bandwidth_lags(n) + 1):
        s0 += 2 * products[k] / n
        s1 += 2 * k * products[k] / n
    return min(n - 1, int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3))) if s0 else 0


def kpss_from_sums(products: Sequence[float], squares: float, lags: int, n: int) -> float:
    """The KPSS statistic with Bartlett weights; ``squares`` is the sum of the squared running sums of the residuals."""
    long_run = (products[0] + 2 * sum((1 - k / (lags + 1)) * products[k] for k in range(1, lags + 1))) / n
    return squares / (n * n * long_run) if long_run > 0 else float("nan")


def _lagged(column: str, lags: int, keys: Sequence[str], order: str) -> Column:
    """The value and those ``1 .. lags`` rows before, as an array; 0 before the first."""
    past = F.reverse(F.collect_list(column).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(-lags, 0)))
    return F.concat(past, F.array_repeat(F.lit(0.0), F.lit(lags + 1) - F.size(past)))


def _test_rows(keys: Sequence[str], regression: str, level: float, held: int, fixed: int | None):
    """For batches of one row for each series the statistics; ``_more`` is the number of lagged products that are lacking, if any."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                n, blank = int(row["_n"]), (float("nan"),) * 3
                if not row["_ok"]:
                    out.append((n, *blank, -1, *blank, -1, "not computed", 0))
                    continue
                lags = kpss_lags(row["_e"], n)
                if lags > held:
                    out.append((n, *blank, -1, *blank, -1, None, lags))
                    continue
                sums = LagSums(n, row["_c"], row["_d"], row["_x1"], row["_x2"], row["_xt"], row["_dt"], row["_head"], row["_tail"])
                t, adf_lags, used = adf_from_sums(sums, regression, fixed)
                critical = sum(c / used**k for k, c in enumerate(ADF_CRITICAL[regression][level]))
                statistic = kpss_from_sums(row["_e"], row["_squares"], lags, n)
                p, q = adf_probability(t, regression), kpss_probability(statistic, regression)
                verdict = "not computed" if math.isnan(t) or math.isnan(statistic) else VERDICTS[p < level, q < level]
                out.append((n, t, p, critical, adf_lags, statistic, q, KPSS_CRITICAL[regression][level], lags, verdict, 0))
            names = ["n", "adf", "adf_p", "adf_critical", "adf_lags", "kpss", "kpss_p", "kpss_critical", "kpss_lags", "verdict", "_more"]
            yield pd.concat([batch[list(keys)].reset_index(drop=True), pd.DataFrame(out, columns=names)], axis=1)

    return run


def unit_root(df: DataFrame, value: str, order_by, series=(), level: float = 0.05, regression: str = "c", adf_lags: int | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``series, n, adf, adf_p, adf_critical, adf_lags, kpss, kpss_p, kpss_critical, kpss_lags, verdict`` for each series, over its finite values.

    The augmented Dickey-Fuller test (null: a unit root; lags by Akaike's criterion unless ``adf_lags`` gives them, at most ``most_lags`` of the shortest series) and the KPSS test (null: stationary; automatic bandwidth), both with a constant (``c``) or with a linear trend too (``ct``). Verdicts: stationary (the
    first null is rejected, the second is not), unit root (the reverse), difference stationary (both are), inconclusive (neither). Series of fewer than 20 values or without variation are not computed; without series the table is one.

    Values are numbered, standardised and cut into chunks that overlap by the lags; each row gives its products with the values before it, which are summed
    by series. All regressions of a series follow from these sums and its first and last values, so no task holds a series.
    """
    if regression not in ADF_CRITICAL or level not in ADF_CRITICAL[regression]:
        raise ValueError(f"regression is one of {list(ADF_CRITICAL)}, level one of {list(ADF_CRITICAL['c'])}")
    keys, order = as_list(series), as_list(order_by)
    rows = df.filter(is_finite(value)).select(*keys, *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.col(value).cast("double").alias("_v"))
    if not keys:
        rows, keys = rows.withColumn("series", F.lit("all")), ["series"]
    placed = along(rows, keys, [f"_o{i}" for i in range(len(order))], place="_t", range_rows=range_rows)
    placed = written(placed.select(F.struct(*keys).alias("_g"), "_t", "_v"))
    t = F.col("_t").cast("double")
    slope = F.try_divide(F.covar_pop(t, F.col("_v")), F.var_pop(t))
    stats = written(placed.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"), F.avg("_v").alias("_m"), F.stddev_pop("_v").alias("_sd"), slope.alias("_b"), ((F.count(F.lit(1)) >= LEAST_ROWS) & (F.max("_v") > F.min("_v"))).alias("_ok")))
    longest = stats.filter("_ok").agg(F.max("_n")).first()[0]
    n = int(longest or 0)
    lags = most_lags(n, regression) if adf_lags is None else adf_lags
    # about the most that the automatic bandwidth asks for; more is asked for below where it is not enough
    held = min(max(n - 1, 0), math.ceil(1.1447 * (1 + _bandwidth_lags(n)) ** (2 / 3) * n ** (1 / 3)))
    z = (F.col("_v") - F.col("_m")) / F.col("_sd")
    trend = F.col("_b") / F.col("_sd") * (F.col("_t") - (F.col("_n") + 1) / 2.0) if regression == "ct" else F.lit(0.0)
    standard = written(placed.join(stats.filter("_ok"), "_g").select("_g", "_t", "_n", z.alias("_z"), (z - trend).alias("_e")))
    squares = along(standard, ["_g"], ["_t"], sums={"_s": F.col("_e")}, range_rows=range_rows).groupBy("_g").agg(F.sum(F.col("_s") * F.col("_s")).alias("_squares"))
    edge = lambda inside: F.transform(F.array_sort(F.collect_list(F.when(inside, F.struct("_t", "_z")))), lambda x: x["_z"])
    last = F.col("_t") < F.col("_n")
    ends = standard.groupBy("_g").agg(
        F.sum(F.when(last, F.col("_z"))).alias("_x1"), F.sum(F.when(last, F.col("_z") * F.col("_z"))).alias("_x2"), F.sum(F.when(last, F.col("_t") * F.col("_z"))).alias("_xt"), edge(F.col("_t") <= lags + 2).alias("_head"), edge(F.col("_t") > F.col("_n") - lags - 2).alias("_tail")
    )
    past, by, place, own = with_past(standard, ["_g"], ["_t"], lags + 2, range_rows)
    before = F.lag("_z").over(Window.partitionBy(*by).orderBy(place))
    moved = past.withColumn("_before", before).withColumn("_dz", F.col("_z") - F.col("_before"))
    moved = moved.withColumn("_ds", _lagged("_dz", lags, by, place)).filter(own & F.col("_dz").isNotNull())
    products = F.concat(F.transform("_ds", lambda d: d * F.col("_dz")), F.transform("_ds", lambda d: d * F.col("_before")))
    differences = moved.select("_g", ((F.col("_t") - 1) * F.col("_dz")).alias("_dt"), array_to_vector(products).alias("_p")).groupBy("_g").agg(F.sum("_dt").alias("_dt"), vector_to_array(Summarizer.sum(F.col("_p"))).alias("_p"))
    moments = written(squares.join(ends, "_g").join(differences, "_g").select("*", F.slice("_p", 1, lags + 1).alias("_c"), F.slice("_p", lags + 2, lags + 1).alias("_d")).drop("_p"))
    schema = T.StructType([*(rows.schema[k] for k in keys), *(T.StructField(c, T.LongType() if c in ("n", "adf_lags", "kpss_lags", "_more") else T.StringType() if c == "verdict" else T.DoubleType()) for c in ("n", "adf", "adf_p", "adf_critical", "adf_lags", "kpss", "kpss_p", "kpss_critical", "kpss_lags", "verdict", "_more"))])
    while True:
        past, by, place, own = with_past(standard, ["_g"], ["_t"], held + 1, range_rows)
        lagged = past.withColumn("_es", _lagged("_e", held, by, place)).filter(own)
        of_residuals = lagged.select("_g", array_to_vector(F.transform("_es", lambda e: e * F.col("_e"))).alias("_p")).groupBy("_g").agg(vector_to_array(Summarizer.sum(F.col("_p"))).alias("_e"))
        every = stats.select("_g", "_n", "_ok").join(moments, "_g", "left").join(of_residuals, "_g", "left")
        out = written(every.select("_g.*", *[c for c in every.columns if c != "_g"]).mapInPandas(_test_rows(keys, regression, level, held, adf_lags), schema))
        more = out.agg(F.max("_more")).first()[0]
        if not more:
            break
        held = int(more)
    unknown = lambda c: F.nanvl(c, F.lit(None).cast("double"))
    return out.drop("_more").withColumns({c: unknown(F.col(c)) for c in ("adf", "adf_p", "adf_critical", "kpss", "kpss_p", "kpss_critical")} | {c: F.when(F.col(c) >= 0, F.col(c)) for c in ("adf_lags", "kpss_lags")})
