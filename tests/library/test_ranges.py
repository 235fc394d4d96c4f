"""Work along an order by ranges of 7 rows against brute force, and exact quantiles by narrowing."""

import datetime as dt
import math
import random
import re
from statistics import median

import pytest
from pyspark.sql import functions as F

from sparkseries.operators import correlogram, ensembles, metrics, profile, ranges, windows
from sparkseries.operators.quantiles import quantiles

R = 7


def series_rows(n: int = 160) -> list[tuple]:
    """(key, place, value): one series with most of the rows, a null series, a short one, long stretches without values."""
    rng = random.Random(4)
    rows = []
    for i in range(n):
        key = rng.choice(["hot"] * 8 + ["b", None])
        value = None if 40 <= i <= 75 or rng.random() < 0.2 else round(rng.uniform(-5, 5), 1)
        rows.append((key, i, value))
    return [*rows, ("one", 5, 1.0), ("none", 5, None), ("none", 6, None)]


def of_series(rows: list[tuple]) -> dict:
    out: dict = {}
    for key, *rest in sorted(rows, key=lambda r: r[1]):
        out.setdefault(key, []).append(tuple(rest))
    return out


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(series_rows(), "k string, t long, v double").repartition(5)


def by_key(df, *columns):
    return {(r["k"], r["t"]): tuple(r[c] for c in columns) for r in df.collect()}


@pytest.mark.parametrize("range_rows", [R, 10_000])
def test_along(df, range_rows):
    v = F.col("v")
    out = ranges.along(df, ["k"], ["t"], place="i", sums={"s": v}, totals={"all": v}, last={"l": v}, following={"f": v}, previous={"p": v}, range_rows=range_rows)
    want = {}
    for key, rows in of_series(series_rows()).items():
        values = [x for _, x in rows]
        for i, (t, _) in enumerate(rows):
            seen, ahead = [x for x in values[: i + 1] if x is not None], [x for x in values[i:] if x is not None]
            want[key, t] = (i + 1, sum(seen), sum(x or 0 for x in values), seen[-1] if seen else None, ahead[0] if ahead else None, values[i - 1] if i else None)
    got = by_key(out, "i", "s", "all", "l", "f", "p")
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k]), k


def test_along_descending_without_series(df):
    got = {r.t: r.s for r in ranges.along(df.filter("k = 'hot'"), [], ["t"], sums={"s": F.lit(1)}, descending=True, range_rows=R).collect()}
    assert [got[t] for t in sorted(got, reverse=True)] == list(range(1, len(got) + 1))
    assert ranges.along(df.filter("t < 0"), ["k"], ["t"], sums={"s": F.lit(1)}).count() == 0


def test_no_window_holds_a_series(df):
    out = windows.interpolate(df, "v", F.col("v") > 0, "t", "k", range_rows=R)
    # of rows: by series and range; of the table with a row for each series and range: by series, in the order of ranges
    windows_of = re.findall(r"windowspecdefinition\(([^,]*), ([^,]*),", out._jdf.queryExecution().analyzed().toString())
    assert windows_of and all("_series" in a and "_range" in b for a, b in windows_of)


@pytest.mark.parametrize("range_rows", [R, 10_000])
def test_interpolate(df, range_rows):
    got = by_key(windows.interpolate(df, "v", F.col("v") > -2, "t", "k", range_rows=range_rows), "v")
    for key, rows in of_series(series_rows()).items():
        good = [(i, x) for i, (_, x) in enumerate(rows) if x is not None and x > -2]
        for i, (t, _) in enumerate(rows):
            a, b = [g for g in good if g[0] <= i], [g for g in good if g[0] >= i]
            if a and b:
                (ia, va), (ib, vb) = a[-1], b[0]
                want = va if ia == ib else va + (vb - va) * (i - ia) / (ib - ia)
            else:
                want = a[-1][1] if a else b[0][1] if b else None
            assert got[key, t][0] == pytest.approx(want)


@pytest.mark.parametrize("range_rows", [R, 10_000])
def test_gaps(spark, range_rows):
    rng, at, rows = random.Random(6), 0.0, []
    for _ in range(90):
        at += rng.choice([0.0, 1.0, 1.0, 1.5, 2.0, 40.0])
        rows.append((rng.choice(["hot", "hot", "hot", None]), at, 1.0))
    got = windows.gap_breaks(spark.createDataFrame(rows, "k string, t double, v double"), "t", "v", "k", 3.0, "w", range_rows).collect()
    assert len(got) == len(rows)
    breaks = 0
    for key in ("hot", None):
        xs = sorted(t for k, t, _ in rows if k == key)
        gaps = [b - a for a, b in zip(xs, xs[1:], strict=False)]
        middle = median([g for g in gaps if g > 0])
        want = sorted([xs[0], *(b for g, b in zip(gaps, xs[1:], strict=True) if not g > 3 * middle)])
        assert sorted(r.t for r in got if r.k == key and r.w is not None) == want
        breaks += sum(g > 3 * middle for g in gaps)
    assert breaks > 5


@pytest.mark.parametrize("range_rows", [R, 10_000])
def test_blocks(df, range_rows):
    rows = df.withColumn("c", F.when(F.col("v") > 1, "up").when(F.col("v") <= 1, "down"))
    got = by_key(windows.change_blocks(rows, "c", "t", "k", range_rows=range_rows), "block")
    for key, some in of_series(series_rows()).items():
        kinds = [None if x is None else x > 1 for _, x in some]
        n = 0
        for i, (t, _) in enumerate(some):
            n += bool(i and kinds[i] is not None and kinds[i - 1] is not None and kinds[i] != kinds[i - 1])
            assert got[key, t] == (n,)


@pytest.mark.parametrize("range_rows", [R, 10_000])
def test_samples(df, range_rows):
    kept = {(r.k, r.t) for r in windows.systematic_sample(df, 10, "t", "k", range_rows).collect()}
    ends = {(r.k, r.t) for r in windows.decimate(df, "t", "v", 10, "k", range_rows=range_rows).collect()}
    want_kept, want_ends = set(), set()
    for key, rows in of_series(series_rows()).items():
        step = max(1, len(rows) // 10)
        want_kept |= {(key, t) for i, (t, _) in enumerate(rows) if i % step == 0}
        good = [(t, x) for t, x in rows if x is not None]
        if len(rows) <= 10:
            want_ends |= {(key, t) for t, _ in rows}
            continue
        buckets: dict = {}
        for i, (t, x) in enumerate(good):
            buckets.setdefault(i * 5 // len(good), []).append((x, i, t))
        for b in buckets.values():
            want_ends |= {(key, min(b)[2]), (key, min(b, key=lambda x: (-x[0], x[1]))[2])}
    assert kept == want_kept and ends == want_ends


@pytest.mark.parametrize("range_rows", [R, 10_000])
def test_nearest(spark, range_rows):
    rng, day = random.Random(8), dt.datetime(2024, 1, 1)
    seen = [(rng.choice(["hot"] * 6 + ["b"]), day + dt.timedelta(minutes=rng.randrange(600)), rng.choice([None, 1.0, 2.0, 3.0])) for _ in range(120)]
    probes = [(k, day + dt.timedelta(minutes=m)) for k in ("hot", "b", "nothing") for m in range(-30, 660, 11)]
    kinds = "k string, t timestamp_ntz"
    out = windows.nearest_value(spark.createDataFrame(seen, f"{kinds}, v double"), spark.createDataFrame(probes, kinds), "t", "v", "t", ["k"], range_rows)
    got = {(r.k, r.t): (r.nearest_time, r.nearest_value) for r in out.collect()}
    assert len(got) == len(probes)
    for k, t in probes:
        found = [(abs((s - t).total_seconds()), s, v) for key, s, v in seen if key == k and v is not None]
        if not found:
            assert got[k, t] == (None, None)
            continue
        best = min(found)[1]
        same = [v for _, s, v in found if s == best]
        assert got[k, t] == (best, max(same) if best <= t else min(same))


@pytest.mark.parametrize("range_rows", [R, 10_000])
def test_ranks_and_curves(spark, range_rows):
    rng = random.Random(9)
    rows = [(rng.choice("ab"), round(rng.random(), 1 if rng.random() < 0.5 else 3), rng.randrange(2)) for _ in range(150)]
    df = spark.createDataFrame(rows, "g string, s double, y int")
    for r in correlogram.average_rank(df, "s", "r", ["g"], range_rows).collect():
        own = [x for g, x, _ in rows if g == r.g]
        assert r.r == sum(x < r.s for x in own) + (sum(x == r.s for x in own) + 1) / 2
    auc = {r.g: r.roc_auc for r in metrics.ranking_scores(df, "y", "s", ["g"], range_rows=range_rows).collect()}
    for g in "ab":
        pos, neg = [[x for k, x, y in rows if k == g and y == c] for c in (1, 0)]
        assert auc[g] == pytest.approx(sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg))
    points = metrics.roc_points(df, "y", "s", range_rows=range_rows).collect()
    for p in points:
        if p.score is not None:
            assert p.tpr == pytest.approx(sum(x >= p.score for _, x, y in rows if y) / sum(y for *_, y in rows))
    assert len(points) == len({x for _, x, _ in rows}) + 1
    blend = {r.s: r.pred for r in ensembles.rank_mean_blend(df, ["s"], range_rows=range_rows).collect()}
    assert min(blend.values()) >= 0 and [blend[x] for x in sorted(blend)] == sorted(blend.values())


def odd_values() -> list[tuple]:
    rng = random.Random(1)
    pick = lambda: rng.choice([None, 1.0, 2.0, math.nan, rng.gauss(0, 1), 10 ** rng.uniform(-300, 300), -math.inf])
    rows = [(rng.choice(["a", "a", "a", None, "b"]), pick(), rng.gauss(100, 5), None if rng.random() < 0.9 else 3.0) for _ in range(1500)]
    return [*rows, ("c", None, 1.0, None), ("d", 5.0, math.inf, 2.0), ("e", math.nan, math.nan, None)]


@pytest.mark.parametrize("by", [[], ["g"]])
def test_quantiles(spark, by):
    df = spark.createDataFrame(odd_values(), "g string, x double, y double, z double")
    columns, shares = {c: F.col(c) for c in "xyz"}, [0, 0.25, 0.5, 0.75, 0.333, 1]

    def told(out):
        text = lambda v: None if v is None else "nan" if math.isnan(v) else f"{v:.10g}"
        return sorted((str(r["g"]) if by else "", str([None if r[c] is None else [text(v) for v in r[c]] for c in "xyz"])) for r in out.collect())

    want = told(quantiles(df, columns, shares, by))
    assert told(quantiles(df, columns, shares, by, exact_rows=40)) == want
    assert told(quantiles(df, columns, shares, by, exact_rows=1)) == want


def test_quantiles_of_many_equal_values(spark):
    df = spark.range(4000).select(F.when(F.col("id") < 2000, 1.0).otherwise(2.0).alias("x"))
    assert quantiles(df, {"x": F.col("x")}, [0.5, 0.1, 1.0], exact_rows=10).first()[0] == [1.5, 1.0, 2.0]


def test_profile_by_narrowing(spark):
    df = spark.createDataFrame(odd_values(), "g string, x double, y double, z double").drop("x")
    a, b = ([tuple(r) for r in profile.column_profile(df, n).orderBy("column").collect()] for n in (10**6, 25))
    assert str(a) == str(b)


@pytest.mark.parametrize("parts", [None, 1, 9])
def test_global_numbers(spark, parts):
    from sparkseries.operators import folds

    rng = random.Random(2)
    rows = [(rng.choice([None, 1, 1, 1, 2]), i) for i in range(200)]
    got = {r.i: r.n for r in folds.global_index(spark.createDataFrame(rows, "k long, i long").repartition(4), ["k", "i"], "n", parts).collect()}
    assert [got[i] for _, i in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))] == list(range(200))
    assert folds.global_index(spark.createDataFrame([], "k long"), ["k"], "n", parts).count() == 0


@pytest.mark.parametrize("range_rows", [R, 10_000])
@pytest.mark.parametrize("most", [None, 60])
def test_correlograms(df, range_rows, most):
    got = {(r.k, r.lag): r.acf for r in correlogram.acf(df, "v", "t", "k", 12, most, range_rows).collect()}
    want = {}
    for key, rows in of_series(series_rows()).items():
        x = [v for _, v in rows if v is not None][-(most or 10**6) :]
        if len(x) >= 10:
            mean = sum(x) / len(x)
            e = [v - mean for v in x]
            want |= {(key, k): sum(a * b for a, b in zip(e, e[k:], strict=False)) / sum(a * a for a in e) for k in range(min(12, len(x) - 1) + 1)}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
