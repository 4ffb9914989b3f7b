import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from houselights.models import abtest, basket, decomposition, regression, series


def monthly(table, values, name="s", first="2010-01-01"):
    months = pd.date_range(first, periods=len(values), freq="MS").strftime("%Y-%m-%d")
    df = table([(name, m, float(v)) for m, v in zip(months, values)], "series_id string, month string, y double")
    return df.withColumn("month", F.col("month").cast("date"))


def column(df, name):
    return np.array([r[name] for r in df.orderBy("series_id", "month").collect()], dtype=float)


def test_linear_fit_matches_least_squares(table):
    rng = np.random.default_rng(2)
    x, z = rng.normal(size=200), rng.integers(0, 3, 200)
    y = 5 + 2 * x + np.array([0, 4, -3])[z] + rng.normal(scale=0.1, size=200)
    df = table([(float(a), str(b), float(c), 1.0) for a, b, c in zip(x, z, y)], "x double, z string, y double, junk double")
    model = regression.fit_linear(df, regression.all_but(df, "y", ["junk"]))
    design = np.column_stack([np.ones(200), x, z == 0, z == 1])
    beta, *_ = np.linalg.lstsq(design, y, rcond=None)
    got = {r.term: r.estimate for r in regression.coefficients(model, df).collect()}
    assert np.isclose(got["x"], beta[1])
    fitted = np.array([r.prediction for r in regression.score(model, df).collect()])
    assert np.allclose(np.sort(fitted), np.sort(design @ beta))
    quality = regression.quality(model, df).first()
    r2 = 1 - ((y - design @ beta) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    assert np.isclose(quality.r2, r2) and np.isclose(quality.adjusted_r2, 1 - (1 - r2) * 199 / 196)


def test_forecast_errors(table):
    df = table([(100.0, 90.0, 110.0), (200.0, 200.0, 260.0)], "revenue double, prediction double, goal double")
    row = regression.forecast_errors(df).first()
    assert np.allclose(list(row), [math.sqrt(50), math.sqrt((100 + 3600) / 2), 5.0, 20.0])
    assert regression.projection_difference(df.withColumn("projected", F.lit(50.0))).first().difference == 40.0


@pytest.fixture(scope="module")
def viewer_rows():
    rng = random.Random(8)
    rows = []
    for i in range(600):
        view, age = rng.randrange(2), rng.randrange(18, 60)
        p = 1 / (1 + math.exp(1 - 1.5 * view - 0.02 * age))
        rows.append((i, int(rng.random() < p), view, float(age)))
    return rows


def test_logistic_identities(spark, viewer_rows):
    df = spark.createDataFrame(viewer_rows, "viewer_id bigint, buy int, view int, age double")
    small, large = regression.fit_logistic(df, "buy ~ view"), regression.fit_logistic(df, "buy ~ view + age")
    rates = {v: np.mean([r[1] for r in viewer_rows if r[2] == v]) for v in (0, 1)}
    scored = {r.view: r.prediction for r in regression.score(small, df).collect()}
    assert all(abs(scored[v] - rates[v]) < 1e-8 for v in rates)
    got = regression.deviance(regression.score(large, df), "buy").first()
    assert abs(got.deviance - large.stages[-1].summary.deviance) < 1e-6
    assert abs(got.deviance + 2 * got.log_likelihood) < 1e-9
    test = regression.likelihood_ratio(small, large, df).first()
    assert test.df == 1 and test.chi_square > 0 and abs(test.p_value - math.erfc(math.sqrt(test.chi_square / 2))) < 1e-10


def test_coefficients_without_full_rank(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 2)) * [1, 50] + [3, 1000]
    y = 5 + x @ [2.0, -0.1] + rng.normal(size=60)
    kinds = ["a" if v > 3 else "b" for v in x[:, 0]]
    rows = [(float(v), float(a), float(b), float(a), float(a - 2 * b), 7.0, k) for v, (a, b), k in zip(y, x, kinds)]
    df = spark.createDataFrame(rows, "y double, a double, b double, a_again double, mix double, same double, kind string")
    full = regression.fit_linear(df, "y ~ a + b + kind")
    want = {r.term: r for r in regression.coefficients(full, df).collect()}
    got = {r.term: r for r in regression.coefficients(regression.fit_linear(
        df, "y ~ a + b + a_again + mix + same + kind"), df).collect()}
    assert set(got) - set(want) == {"a_again", "mix", "same"}
    assert all(got[t][1:] == (None, None, None) for t in ("a_again", "mix", "same"))
    for term, row in want.items():
        assert got[term][1:] == pytest.approx(tuple(row)[1:], rel=1e-6)


def test_ab_worked_example(table):
    data = ([("receive", 1)] * 1225 + [("receive", 0)] * 6275 + [("no_receive", 1)] * 375 + [("no_receive", 0)] * 2125)
    got = abtest.conversion(table(data, "variant string, converted int"))
    by = {r.variant: r for r in got.collect()}
    assert abs(by["receive"].rate - 1225 / 7500) < 1e-12 and by["no_receive"].size == 2500
    a, b = 375, 2125
    assert abs(by["no_receive"].posterior_variance - a * b / ((a + b) ** 2 * (a + b + 1))) < 1e-15
    assert not abtest.separated(got, "receive", "no_receive").first().is_separated
    more = table([("receive", 1)] * 1500 + [("receive", 0)] * 6000 + data[7500:], "variant string, converted int")
    assert abtest.separated(abtest.conversion(more), "receive", "no_receive").first().is_separated


def test_frequent_itemsets_match_counting(table):
    rng = random.Random(4)
    carts = [sorted({rng.choice("abcdef") for _ in range(rng.randrange(1, 5))}) for _ in range(200)]
    df = table([(i, items) for i, items in enumerate(carts)], "summary_cust_id bigint, items array<string>")
    want = {}
    for size in (2, 3, 4):
        for combo in itertools.combinations("abcdef", size):
            n = sum(set(combo) <= set(cart) for cart in carts)
            if n / 200 >= 0.1:
                want["|".join(combo)] = n
    got = {r["items"]: r.freq for r in basket.frequent_itemsets(df, 0.1, k=None).collect()}
    assert got == want
    rules = basket.association_rules(df, 0.1, 0.3).where(F.col("antecedent") == "a").collect()
    n_a = sum("a" in cart for cart in carts)
    assert rules and all(abs(r.confidence - sum({"a", r.consequent} <= set(x) for x in carts) / n_a) < 1e-12 for r in rules)


def test_baskets_leave_out_subscribers(tickets, table):
    t = ["2019-01-31 20:00:00", "2019-02-01 20:00:00", "2019-03-01 20:00:00"]
    seats = tickets([(1, "Single ", 9, t[0]), (1, "Single ", 9, t[0]), (1, "Single ", 9, t[1]), (1, "Single ", 9, t[2]),
                     (2, "Single ", 9, t[0]), (2, "Flex", 9, t[1])])
    shows = table([(t[0], "Ninth"), (t[1], "Fifth"), (t[2], None)], "perf_dt string, name string", ["perf_dt"])
    assert [(r.summary_cust_id, r["items"]) for r in basket.baskets(seats, shows).collect()] == [(1, ["Fifth", "Ninth"])]


def test_differences_and_lags(table):
    df = monthly(table, [1, 4, 9, 16])
    assert list(column(series.difference(df), "y")) == [3, 5, 7]
    assert series.lagged_pairs(df, 2).count() == 3 + 2
    naive = series.seasonal_naive(monthly(table, list(range(24))))
    assert set(column(naive.where("residual is not null"), "residual")) == {12.0}


def test_lag_correlations_of_constant_series_are_unknown(table):
    y = list(np.random.default_rng(9).normal(size=30))
    late = [7.0] * 6 + [9.0]
    df = monthly(table, y).union(monthly(table, [1500.0] * 30, "flat")).union(monthly(table, [0.1] * 7, "tenth")).union(
        monthly(table, late, "late")).union(monthly(table, [3.0, 4.0], "pair"))
    got = {(r.series_id, r.lag): r.correlation for r in series.lag_correlations(df).collect()}
    assert len(got) == 4 * 4 + 1 and all(v is None for (name, _), v in got.items() if name != "s")
    assert all(np.isclose(got["s", k], np.corrcoef(y[k:], y[:-k])[0, 1]) for k in (1, 2, 3, 4))


def test_ljung_box_matches_formula(table):
    rng = np.random.default_rng(5)
    y = rng.normal(size=60)
    df = monthly(table, y).withColumn("residual", F.col("y"))
    e = y - y.mean()
    acf = [(e[k:] * e[:-k]).sum() / (e * e).sum() for k in (1, 2, 3, 4)]
    got = series.residual_autocorrelation(df).orderBy("lag").collect()
    assert np.allclose([r.acf for r in got], acf)
    assert np.isclose(got[-1].q, 60 * 62 * sum(r * r / (60 - k) for k, r in enumerate(acf, 1)))


@pytest.mark.parametrize("level", [0.0, 0.1])
def test_autocorrelation_of_constant_residuals_is_unknown(table, level):
    y = list(np.random.default_rng(5).normal(size=30))
    df = monthly(table, y).union(monthly(table, [level] * 30, "flat")).withColumn("residual", F.col("y"))
    got = series.residual_autocorrelation(df).collect()
    flat = [r for r in got if r.series_id == "flat"]
    assert sorted(r.lag for r in flat) == [1, 2, 3, 4] and all((r.acf, r.q, r.p_value) == (None, None, None) for r in flat)
    alone = series.residual_autocorrelation(df.where("series_id = 's'")).collect()
    assert sorted(r for r in got if r.series_id == "s") == sorted(alone) and all(r.p_value is not None for r in alone)


def test_decomposition_recovers_parts(table):
    season = np.array([5, 3, -2, -6, 1, 4, -3, 2, 0, -1, -5, 2.0])
    season -= season.mean()
    y = [10 + 0.5 * t + season[t % 12] for t in range(60)]
    parts = series.decompose(monthly(table, y)).where("trend is not null")
    assert np.allclose(column(parts, "remainder"), 0) and np.allclose(column(parts, "trend")[0], 10 + 0.5 * 6)
    assert np.allclose(column(parts, "seasonal")[:6], season[6:])


def test_autoregression_matches_least_squares_and_recursion(table):
    rng = np.random.default_rng(6)
    y = list(rng.normal(50, 10, 72))
    fit = series.seasonal_autoregression(monthly(table, y)).first()
    design = np.column_stack([np.ones(60), y[11:71], y[:60]])
    beta, *_ = np.linalg.lstsq(design, np.array(y[12:]), rcond=None)
    assert np.allclose([fit.constant, fit.phi_1, fit.phi_12], beta) and fit.n == 60
    path, want = list(y), []
    for _ in range(5):
        path.append(beta[0] + beta[1] * path[-1] + beta[2] * path[-12])
        want.append(path[-1])
    got = series.autoregressive_forecast(monthly(table, y), 5)
    assert np.allclose(column(got, "forecast"), want) and str(got.agg(F.min("month")).first()[0]) == "2016-01-01"
    rest = np.array(y[12:]) - design @ beta
    assert np.isclose(fit.residual_sd, np.sqrt((rest ** 2).sum() / 57))
    low, high, middle = (column(got, name) for name in ("low", "high", "forecast"))
    shocks = np.cumsum([beta[1] ** (2 * k) for k in range(5)])
    assert np.allclose((high - low) / 2, series.Z_95 * fit.residual_sd * np.sqrt(shocks)) and (low < middle).all()


def test_autoregression_goes_beyond_a_year_and_keeps_short_series(table):
    y = list(np.random.default_rng(7).normal(50, 10, 40))
    long = series.autoregressive_forecast(monthly(table, y), 30)
    year = series.autoregressive_forecast(monthly(table, y), 12)
    assert np.allclose(column(long, "forecast")[:12], column(year, "forecast")) and long.count() == 30
    short = series.autoregressive_forecast(monthly(table, y[:9]), 3).collect()
    assert len(short) == 3 and all(r.forecast is None for r in short)
    assert series.seasonal_autoregression(monthly(table, y[:9])).first().phi_1 is None


def test_simple_smoothing(table):
    assert np.isclose(series.simple_smoothing(monthly(table, [10, 20, 30]), 0.5).first().level, 22.5)
    assert series.simple_smoothing(monthly(table, [10])).first().level == 10.0


def test_triple_smoothing_continues_a_regular_series(table):
    season = [5, 3, -2, -6, 1, 4, -3, 2, 0, -1, -5, 2]
    y = [100 + 2 * t + season[t % 12] for t in range(72)]
    both = monthly(table, y, "a").unionByName(monthly(table, [7.0] * 10, "short"))
    rows = series.exponential_smoothing(both, 12).orderBy("series_id", "month").collect()
    got, short = rows[:12], rows[12:]
    assert {(r.series_id, r.method) for r in rows} == {("a", "triple"), ("short", "level")} and len(short) == 12
    assert all(np.isclose(r.forecast, 7.0) and r.low is None for r in short) and str(short[0].month) == "2010-11-01"
    want = [100 + 2 * t + season[t % 12] for t in range(72, 84)]
    assert np.allclose([r.forecast for r in got], want)
    assert all(r.low <= r.forecast <= r.high for r in got)
    y = np.array(y) + np.random.default_rng(1).normal(scale=3, size=72)
    near = series.exponential_smoothing(monthly(table, y), 30).orderBy("month").collect()
    assert np.allclose([r.forecast for r in near[:3]], want[:3], atol=12) and 2 < near[0].residual_sd < 6


def test_triple_smoothing_matches_a_plain_loop(table):
    y = np.random.default_rng(3).normal(50, 9, 40) + np.tile([9, -4, 0, 3] * 3, 4)[:40]

    def errors(alpha, beta, gamma):
        centre = y[:12].mean()
        trend = (y[12:24].mean() - centre) / 12
        season = [y[i] - centre - (i - 5.5) * trend for i in range(12)]
        level, out = centre + 5.5 * trend, []
        for t in range(12, 40):
            effect, before = season[t % 12], level
            out.append(y[t] - (level + trend + effect))
            level = alpha * (y[t] - effect) + (1 - alpha) * (level + trend)
            trend = beta * (level - before) + (1 - beta) * trend
            season[t % 12] = gamma * (y[t] - level) + (1 - gamma) * effect
        return np.array(out)

    best = min((errors(*w) for w in series.GRID), key=lambda e: (e ** 2).sum())
    got = series.smoothing_accuracy(monthly(table, y)).first()
    assert np.allclose([got.n, got.me, got.rmse, got.mae],
                       [28, best.mean(), np.sqrt((best ** 2).mean()), np.abs(best).mean()])


@pytest.mark.parametrize("degree", [1, 3, 8])
def test_polynomial_trend_matches_polyfit(table, degree):
    rng = np.random.default_rng(degree)
    x = np.linspace(-1, 1, 80)
    y = 3 + x - 2 * x ** 3 + rng.normal(scale=0.2, size=80)
    got = series.polynomial_trend(monthly(table, y), degree)
    assert np.allclose(column(got, "fitted"), np.polyval(np.polyfit(x, y, degree), x))
    assert (column(got, "high") > column(got, "low")).all()


def test_polynomial_needs_more_months_than_its_degree(table):
    both = monthly(table, [1.0, 4.0, 9.0], "few").unionByName(monthly(table, [1.0, 4.0, 9.0, 16.0], "enough"))
    rows = series.polynomial_trend(both, 3).collect()
    assert all(r.fitted is None for r in rows if r.series_id == "few")
    assert all(np.isclose(r.fitted, r.y) and r.low is None for r in rows if r.series_id == "enough") and len(rows) == 7


def test_t_quantile(spark):
    points = {1: 12.706205, 2: 4.302653, 3: 3.182446, 4: 2.776445, 10: 2.228139, 30: 2.042272, 61: 1.999624, 120: 1.979930}
    rows = spark.createDataFrame([(n,) for n in points], "n int").select("n", series.t_quantile_975(F.col("n")).alias("q"))
    assert all(abs(r.q - points[r.n]) < 1e-6 for r in rows.collect())


def test_baseline_is_the_first_level_and_p_values_are_those_of_t(table):
    rng = np.random.default_rng(2)
    kind = rng.choice(["a", "b", "c"], 60, p=[0.1, 0.3, 0.6])
    y = 2.0 + (kind == "b") + rng.normal(size=60)
    df = table([(str(k), float(v)) for k, v in zip(kind, y)], "kind string, y double")
    rows = {r.term: r for r in regression.coefficients(regression.fit_linear(df, "y ~ kind"), df).collect()}
    assert set(rows) == {"(Intercept)", "kind_b", "kind_c"}
    design = np.column_stack([np.ones(60), kind == "b", kind == "c"]).astype(float)
    beta, *_ = np.linalg.lstsq(design, y, rcond=None)
    inverse = np.linalg.inv(design.T @ design)
    error = np.sqrt(((y - design @ beta) ** 2).sum() / 57 * np.diag(inverse))
    assert np.allclose([rows[t].estimate for t in ("(Intercept)", "kind_b", "kind_c")], beta)
    assert np.allclose([rows[t].std_error for t in ("(Intercept)", "kind_b", "kind_c")], error)
    grid = np.linspace(-abs(beta[1] / error[1]), abs(beta[1] / error[1]), 20001)
    density = math.exp(math.lgamma(29) - math.lgamma(28.5)) / math.sqrt(57 * math.pi) * (1 + grid ** 2 / 57) ** -29
    assert abs(rows["kind_b"].p_value - (1 - np.trapezoid(density, grid))) < 1e-6


def test_local_decomposition(spark):
    rng = np.random.default_rng(6)
    t = np.arange(60)
    season = np.array([4.0, -3, 2, 5, -6, 1, 0, -2, 3, -4, 1, -1])
    ys = 20 + 0.5 * t + np.tile(season, 5)
    rows = [("line", i, y) for i, y in enumerate(ys)] + [("spike", i, y + (200 if i == 30 else 0)) for i, y in enumerate(ys)]
    rows += [("short", i, float(y)) for i, y in enumerate(rng.normal(size=8))] + [("one", 0, 3.0)]
    df = spark.createDataFrame([(k, int(i), float(y)) for k, i, y in rows], "series_id string, i int, y double").select(
        "series_id", F.add_months(F.lit("2001-01-01").cast("date"), F.col("i")).alias("month"), "y")

    def parts(robust):
        out = {}
        for r in decomposition.local_decomposition(df, robust).orderBy("month").collect():
            out.setdefault(r.series_id, []).append(r)
        return out

    plain, robust = parts(False), parts(True)
    for got in (plain, robust):
        # A straight line with a season comes back, at the ends as well; a little of its slope stays in the season.
        assert np.allclose([r.seasonal for r in got["line"]][:12], season - season.mean(), atol=0.7)
        assert np.allclose([r.trend for r in got["line"]], 20 + 0.5 * t, atol=1.0)
        assert [r.seasonal for r in got["short"]] == [0.0] * 8 and got["one"][0].trend == 3.0
        assert all(abs(r.y - r.trend - r.seasonal - r.remainder) < 1e-9 for rows in got.values() for r in rows)
    assert abs(robust["spike"][30].trend - 35) < 1.5 < abs(plain["spike"][30].trend - 35)
    assert robust["spike"][30].remainder > 190


def test_local_line_is_weighted_least_squares(spark):
    rng = np.random.default_rng(9)
    ys, w = rng.normal(size=40), rng.uniform(0.2, 1, 40)
    got = spark.createDataFrame([(ys.tolist(), w.tolist())], "ys array<double>, w array<double>").select(
        decomposition.local_line(F.col("ys"), F.col("w")).alias("l")).first().l
    for i in range(40):
        first = max(0, min(i - 9, 21))
        j = np.arange(first, first + 19)
        weight = w[j] * np.clip(1 - (np.abs(j - i) / max(i - first, first + 18 - i)) ** 3, 0, None) ** 3
        slope, level = np.polyfit(j - i, ys[j], 1, w=np.sqrt(weight))
        assert got[i] == pytest.approx(level, abs=1e-6)
