"""The choice among smoothing forms: forms of generated series, one fold against plain numpy, short series."""

import datetime

import numpy as np
import pytest

from houselights.models import series, smoothing


def monthly(spark, named):
    rows = [(name, datetime.date(1990 + i // 12, i % 12 + 1, 1), float(y)) for name, ys in named.items() for i, y in enumerate(ys)]
    return spark.createDataFrame(rows, "series_id string, month date, y double")


def made():
    rng = np.random.default_rng(4)
    t, noise = np.arange(96), rng.normal(size=96)
    season = np.array([3.0, -4, 1, 6, -2, -6, 0, 5, -5, 2, 4, -4])
    return {
        "level": 50 + noise, "trend": 50 + 2 * t + noise, "seasonal": 50 + np.tile(season, 8) * 4 + noise,
        "growing": (50 + 3 * t) * np.tile(1 + season / 12, 8) * (1 + noise / 100), "zeros": np.tile([0.0, 0, 5, 1], 24),
        "even": np.full(40, 3.0), "short": [4.0, 6.0, 5.0, 5.5, 4.5, 5.0, 5.2, 4.9], "two": [1.0, 2.0], "one": [9.0]}


@pytest.fixture(scope="module")
def chosen(spark):
    return {r.series_id: r for r in smoothing.choose_smoothing(monthly(spark, made())).collect()}


def test_forms_of_generated_series(chosen):
    form = {name: r.form[4:-1].split(",") for name, r in chosen.items()}
    assert form["level"][1:] == ["N", "N"] and form["trend"][1] == "A" and form["trend"][2] == "N"
    assert form["seasonal"][2] == "A" and form["growing"][0] == "M" and form["growing"][2] == "M" and form["growing"][1] != "N"
    assert form["zeros"][0] == "A" and form["zeros"][2] != "M"


def test_every_series_has_its_accuracy(chosen):
    assert set(chosen) == set(made()) and all(r.rmse is not None and r.mae is not None for r in chosen.values())
    assert chosen["one"].form == chosen["two"].form == "ETS(A,N,N)" and chosen["one"].aicc is None and chosen["one"].n == 1
    assert chosen["even"].rmse == 0 and chosen["short"].form == "ETS(A,N,N)"
    assert 0.7 < chosen["level"].rmse < 1.3 and 0.7 < chosen["seasonal"].rmse < 1.5 and chosen["growing"].mape < 2


def test_fold_against_numpy(chosen):
    """The multiplicative form, month by month."""
    ys, r = made()["growing"], chosen["growing"]
    slope = (ys[12:24].mean() - ys[:12].mean()) / 12
    start = ys[:12].mean() - 6.5 * slope
    line = start + slope * np.arange(1, 25)
    times = (ys[:24] / line).reshape(2, 12).mean(axis=0)
    level, trend, effects, errors = start, slope, list(times / times.mean()), []
    for y in ys:
        base = level + (r.phi or 1) * trend
        fitted = base * effects[0]
        errors.append(y - fitted)
        relative = (y - fitted) / fitted
        level, trend = base * (1 + r.alpha * relative), (r.phi or 1) * trend + r.beta * base * relative
        effects = effects[1:] + [effects[0] * (1 + r.gamma * relative)]
    assert r.rmse == pytest.approx(np.sqrt(np.mean(np.square(errors)))) and r.me == pytest.approx(np.mean(errors))


def test_forecasts(spark):
    got = {}
    for r in smoothing.smoothing_forecast(monthly(spark, made()), 15).orderBy("month").collect():
        got.setdefault(r.series_id, []).append(r)
    assert all(len(rows) == 15 for rows in got.values())
    assert abs(got["trend"][0].forecast - 242) < 4 and abs(got["trend"][11].forecast - 264) < 6
    assert abs(got["seasonal"][3].forecast - 74) < 3 and abs(got["seasonal"][12].forecast - 62) < 3
    assert abs(got["growing"][3].forecast / ((50 + 3 * 99) * 1.5) - 1) < 0.05
    for name in ("level", "trend", "seasonal", "growing"):
        assert all(r.low < r.forecast < r.high for r in got[name])
        assert got[name][-1].high - got[name][-1].low >= (got[name][0].high - got[name][0].low) * 0.6
    assert [r.forecast for r in got["even"]] == [3.0] * 15 and got["one"][0].forecast == 9.0 and got["one"][0].low is None


def test_short_series_keep_their_accuracy_row(spark):
    got = {r.series_id: r for r in series.smoothing_accuracy(monthly(spark, made())).collect()}
    assert set(got) == set(made()) and got["short"].rmse is None and got["short"].n == 0 and got["level"].n == 84
