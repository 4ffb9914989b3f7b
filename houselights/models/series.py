"""Monthly time series, many at a time: every step works on (series_id, month, y) grouped by series.

A series holds one row per calendar month, so per-series windows and groups are small however many series there are.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from houselights.functions.tails import chi_square_tail

SEASON = 12
Z_95 = 1.959964  # Fixed value: two-sided 95 % point of the normal distribution.
# Candidate weights of level, trend and season.
GRID = tuple((a, b, g) for a in (0.1, 0.3, 0.5, 0.8) for b in (0.01, 0.1, 0.3) for g in (0.05, 0.2, 0.5))


def _by_series() -> WindowSpec:
    return Window.partitionBy("series_id").orderBy("month")


def difference(series: DataFrame) -> DataFrame:
    """Change from month to month; the first month has none."""
    return (series.withColumn("y", F.col("y") - F.lag("y", 1).over(_by_series())).where(F.col("y").isNotNull()))


def lagged_pairs(series: DataFrame, lags: int = 4, keep: Sequence[str] = ()) -> DataFrame:
    """Each value with its value 1..k months earlier (the points of a lag plot)."""
    pairs = F.array(*[F.struct(F.lit(k).alias("lag"), F.lag("y", k).over(_by_series()).alias("lagged"))
                      for k in range(1, lags + 1)])
    columns = ["series_id", "month", "y", *keep]
    return (series.withColumn("_p", pairs).select(*columns, F.explode("_p").alias("_p"))
            .select(*columns, "_p.lag", "_p.lagged").where(F.col("lagged").isNotNull()))


def lag_correlations(series: DataFrame, lags: int = 4) -> DataFrame:
    """Correlation of each value with the one 1..k months earlier; unknown where either side is constant."""
    spread = F.stddev_pop("y") * F.stddev_pop("lagged")
    return lagged_pairs(series, lags).groupBy("series_id", "lag").agg(
        F.try_divide(F.covar_pop("y", "lagged"), spread).alias("correlation"))


def seasonal_naive(series: DataFrame) -> DataFrame:
    """Forecast each month by the same month a year earlier."""
    fitted = F.lag("y", SEASON).over(_by_series())
    return series.withColumns({"fitted": fitted, "residual": F.col("y") - fitted})


def residual_deviation(fitted: DataFrame) -> DataFrame:
    known = fitted.where(F.col("residual").isNotNull())
    return known.groupBy("series_id").agg(F.count("*").alias("n"), F.stddev_samp("residual").alias("residual_sd"),
                                          F.sqrt(F.avg(F.pow("residual", 2))).alias("rmse"),
                                          F.avg(F.abs("residual")).alias("mae"))


def residual_autocorrelation(fitted: DataFrame, lags: int = 4) -> DataFrame:
    """Autocorrelations of the residuals and the cumulative Ljung-Box statistic by lag, with the probability that a series
    without autocorrelation exceeds it. All three are unknown where the residuals are constant."""
    whole = Window.partitionBy("series_id")
    varies = F.max("residual").over(whole) > F.min("residual").over(whole)
    centred = (fitted.where(F.col("residual").isNotNull())
               .withColumns({"y": F.col("residual") - F.avg("residual").over(whole), "_varies": varies})
               .withColumns({"ss": F.sum(F.when(F.col("_varies"), F.col("y") * F.col("y"))).over(whole),
                             "n": F.count("*").over(whole)}))
    by_lag = lagged_pairs(centred, lags, keep=("ss", "n")).groupBy("series_id", "lag").agg(
        F.try_divide(F.sum(F.col("y") * F.col("lagged")), F.max("ss")).alias("acf"), F.max("n").alias("n"))
    running = Window.partitionBy("series_id").orderBy("lag").rowsBetween(Window.unboundedPreceding, 0)
    part = F.col("acf") * F.col("acf") / (F.col("n") - F.col("lag"))
    return by_lag.select("series_id", "lag", "acf", (F.col("n") * (F.col("n") + 2) * F.sum(part).over(running)).alias("q")
                         ).withColumn("p_value", chi_square_tail(F.col("q"), F.col("lag")))


def seasonal_view(series: DataFrame, years: Sequence[int] | None = None) -> DataFrame:
    """Month of year by year (the table behind a seasonal plot). Without stated years all years of the data are shown."""
    dated = series.select("series_id", F.month("month").alias("month_of_year"), F.year("month").alias("year"), "y")
    if years is None:
        years = sorted(row["year"] for row in dated.select("year").distinct().collect())
    return dated.groupBy("series_id", "month_of_year").pivot("year", list(years)).agg(F.first("y"))


def decompose(series: DataFrame) -> DataFrame:
    """Classical additive decomposition: centred 2x12 moving average, month effects summing to zero, remainder."""
    def span(low: int, high: int):
        return _by_series().rowsBetween(low, high)

    whole = Window.partitionBy("series_id")
    complete = F.count("y").over(span(-6, 6)) == 13
    centred = (F.sum("y").over(span(-6, 5)) + F.sum("y").over(span(-5, 6))) / 24
    trended = series.withColumn("trend", F.when(complete, centred))
    by_month = Window.partitionBy("series_id", "_m")
    effects = (trended.withColumn("_m", F.month("month"))
               .withColumns({"_e": F.avg(F.col("y") - F.col("trend")).over(by_month),
                             "_w": 1 / F.count("*").over(by_month)}))
    weight = F.when(F.col("_e").isNotNull(), F.col("_w"))
    seasonal = F.col("_e") - F.sum(F.col("_e") * weight).over(whole) / F.sum(weight).over(whole)
    return (effects.withColumn("seasonal", seasonal)
            .select("series_id", "month", "y", "trend", "seasonal",
                    (F.col("y") - F.col("trend") - F.col("seasonal")).alias("remainder")))


def _values() -> Column:
    """Aggregate: the values of a series in month order."""
    return F.transform(F.sort_array(F.collect_list(F.struct("month", "y"))), lambda p: p["y"])


def _autoregression(series: DataFrame, **more: Column) -> DataFrame:
    """Per series: y on its value one month and one year earlier, by two-predictor least squares from covariances.

    A series of a year or less keeps its row, with no coefficients.
    """
    lagged = series.withColumns({"l1": F.lag("y", 1).over(_by_series()), "l12": F.lag("y", SEASON).over(_by_series())})
    whole_year = F.col("l12").isNotNull()
    y, l1, l12 = (F.when(whole_year, F.col(name)) for name in ("y", "l1", "l12"))
    s11, s22, s12 = F.var_samp(l1), F.var_samp(l12), F.covar_samp(l1, l12)
    s1y, s2y = F.covar_samp(l1, y), F.covar_samp(l12, y)
    determinant = s11 * s22 - s12 * s12
    moments = lagged.groupBy("series_id").agg(
        F.count_if(whole_year).alias("n"),
        F.try_divide(s1y * s22 - s2y * s12, determinant).alias("phi_1"),
        F.try_divide(s2y * s11 - s1y * s12, determinant).alias("phi_12"),
        F.avg(y).alias("_y"), F.avg(l1).alias("_l1"), F.avg(l12).alias("_l12"),
        F.var_samp(y).alias("_yy"), s1y.alias("_1y"), s2y.alias("_2y"),
        *[column.alias(name) for name, column in more.items()])
    constant = F.col("_y") - F.col("phi_1") * F.col("_l1") - F.col("phi_12") * F.col("_l12")
    unexplained = F.col("_yy") - F.col("phi_1") * F.col("_1y") - F.col("phi_12") * F.col("_2y")
    residual_sd = F.sqrt(F.try_divide(unexplained * (F.col("n") - 1), F.when(F.col("n") > 3, F.col("n") - 3)))
    return moments.select("series_id", "n", constant.alias("constant"), "phi_1", "phi_12",
                          residual_sd.alias("residual_sd"), *more)


def seasonal_autoregression(series: DataFrame) -> DataFrame:
    """Coefficients and residual deviation of the seasonal autoregression of every series."""
    return _autoregression(series)


def autoregressive_forecast(series: DataFrame, horizon: int = 12) -> DataFrame:
    """The next months by the seasonal autoregression, with 95 % intervals.

    The forecasts are folded onto the last twelve values, the weights of past shocks onto eleven zeros and a one. Without
    coefficients a series keeps its rows, with no forecast.
    """
    models = _autoregression(series, last_month=F.max("month"), recent=F.slice(_values(), -SEASON, SEASON))
    steps = F.sequence(F.lit(1), F.lit(horizon))
    path = F.aggregate(steps, F.col("recent"), lambda done, _: F.concat(done, F.array(
        F.col("constant") + F.col("phi_1") * F.element_at(done, -1) + F.col("phi_12") * F.element_at(done, -SEASON))))
    impulse = F.array(*[F.lit(0.0)] * (SEASON - 1), F.lit(1.0))
    shocks = F.aggregate(steps, impulse, lambda done, _: F.concat(done, F.array(
        F.col("phi_1") * F.element_at(done, -1) + F.col("phi_12") * F.element_at(done, -SEASON))))
    known = F.col("phi_1").isNotNull()
    models = models.withColumns({"path": F.when(known, F.slice(path, SEASON + 1, horizon)),
                                 "shocks": F.when(known, F.slice(shocks, SEASON, horizon))})
    spread = F.sqrt(F.aggregate(F.slice("shocks", 1, F.col("step")), F.lit(0.0), lambda total, w: total + w * w))
    half = F.col("residual_sd") * spread * Z_95
    forecast = F.get("path", F.col("step") - 1)
    return (models.withColumn("step", F.explode(steps))
            .select("series_id", F.add_months("last_month", F.col("step")).alias("month"), forecast.alias("forecast"),
                    (forecast - half).alias("low"), (forecast + half).alias("high")))


def _level(values: Column, alpha: float) -> Column:
    """The level of simple exponential smoothing after the last value."""
    return F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.element_at(values, 1),
                       lambda level, y: level * (1 - alpha) + y * alpha)


def simple_smoothing(series: DataFrame, alpha: float = 0.3) -> DataFrame:
    """Simple exponential smoothing with a given weight: the level after the last month is the forecast."""
    values = series.groupBy("series_id").agg(_values().alias("ys"))
    return values.select("series_id", _level(F.col("ys"), alpha).alias("level"))


def _triple_smoothing(series: DataFrame) -> DataFrame:
    """Series of two years and more after additive triple smoothing, with the weights of least squared one-step errors.

    Each of the candidate weights folds the series into level, trend, twelve month effects and sums of its errors.
    """
    weights = F.array(*[F.struct(F.lit(a).alias("alpha"), F.lit(b).alias("beta"), F.lit(g).alias("gamma")) for a, b, g in GRID])
    rows = (series.groupBy("series_id").agg(_values().alias("ys"), F.max("month").alias("last_month"))
            .withColumn("n", F.size("ys")).where(F.col("n") >= 2 * SEASON))

    def mean(from_: int) -> Column:
        return F.aggregate(F.slice("ys", from_, SEASON), F.lit(0.0), lambda total, y: total + y) / SEASON

    rows = rows.withColumn("centre", mean(1)).withColumn("slope", (mean(SEASON + 1) - F.col("centre")) / SEASON)
    rows = rows.withColumn("w", F.explode(weights)).select("*", "w.*")
    offset = (SEASON - 1) / 2
    start = F.struct(
        (F.col("centre") + offset * F.col("slope")).alias("level"), F.col("slope").alias("trend"),
        F.transform(F.slice("ys", 1, SEASON), lambda y, i: y - F.col("centre") - (i - offset) * F.col("slope")).alias("season"),
        *[F.lit(0.0).alias(name) for name in ("sse", "se", "sae")])

    def step(state: Column, t: Column) -> Column:
        y, spot = F.get("ys", t), t % SEASON
        effect = F.get(state["season"], spot)
        ahead = state["level"] + state["trend"]
        error = y - (ahead + effect)
        level = F.col("alpha") * (y - effect) + (1 - F.col("alpha")) * ahead
        trend = F.col("beta") * (level - state["level"]) + (1 - F.col("beta")) * state["trend"]
        season = F.transform(state["season"], lambda old, i: F.when(
            i == spot, F.col("gamma") * (y - level) + (1 - F.col("gamma")) * old).otherwise(old))
        return F.struct(level.alias("level"), trend.alias("trend"), season.alias("season"),
                        (state["sse"] + error * error).alias("sse"), (state["se"] + error).alias("se"),
                        (state["sae"] + F.abs(error)).alias("sae"))

    folded = rows.withColumn("end", F.aggregate(F.sequence(F.lit(SEASON), F.col("n") - 1), start, step))
    best = folded.groupBy("series_id").agg(F.min_by(
        F.struct("last_month", "n", "alpha", "beta", "gamma", "end.*"), F.col("end.sse")).alias("best"))
    errors = F.col("n") - SEASON
    return best.select("series_id", "best.*").withColumn(
        "residual_sd", F.sqrt((F.col("sse") - F.col("se") * F.col("se") / errors) / (errors - 1)))


def exponential_smoothing(series: DataFrame, horizon: int = 12, alpha: float = 0.3) -> DataFrame:
    """Forecasts by additive triple smoothing, weights chosen on a grid by one-step errors; 95 % intervals.

    `method` says what made a row: a series shorter than two years is carried on at its smoothed level, without interval.
    """
    ahead = F.explode(F.sequence(F.lit(1), F.lit(horizon)))
    h = F.col("h")
    spread = F.aggregate(F.sequence(F.lit(0), h - 1), F.lit(0.0), lambda total, j: total + F.when(j == 0, F.lit(1.0)).otherwise(
        F.pow(F.col("alpha") * (1 + j * F.col("beta"))
              + F.when(j % SEASON == 0, F.col("gamma") * (1 - F.col("alpha"))).otherwise(0.0), 2)))
    point = F.col("level") + h * F.col("trend") + F.get("season", (F.col("n") + h - 1) % SEASON)
    half = F.col("residual_sd") * F.sqrt(spread) * Z_95
    month = F.add_months("last_month", h).alias("month")
    triple = _triple_smoothing(series).withColumn("h", ahead).select(
        "series_id", month, F.lit("triple").alias("method"), point.alias("forecast"), (point - half).alias("low"),
        (point + half).alias("high"), "residual_sd")
    short = (series.groupBy("series_id").agg(_values().alias("ys"), F.max("month").alias("last_month"))
             .where(F.size("ys") < 2 * SEASON).withColumn("h", ahead))
    unknown = F.lit(None).cast("double")
    return triple.union(short.select("series_id", month, F.lit("level"), _level(F.col("ys"), alpha), unknown, unknown, unknown))


def smoothing_accuracy(series: DataFrame) -> DataFrame:
    """Errors of the one-step forecasts of triple smoothing: count, mean, root mean square and mean size. A series under two
    years keeps its row, without errors."""
    errors = F.col("n") - SEASON
    triple = _triple_smoothing(series).select(
        "series_id", errors.cast("bigint").alias("n"), (F.col("se") / errors).alias("me"),
        F.sqrt(F.col("sse") / errors).alias("rmse"), (F.col("sae") / errors).alias("mae"))
    short = series.groupBy("series_id").count().where(F.col("count") < 2 * SEASON)
    unknown = F.lit(None).cast("double")
    return triple.union(short.select("series_id", F.lit(0).cast("bigint"), unknown, unknown, unknown))


def t_quantile_975(freedom: Column) -> Column:
    """Two-sided 95 % point of Student's t for whole degrees of freedom, by halving the angle of its closed-form
    distribution sixty times."""
    odd = freedom % 2 == 1

    def inside(angle: Column) -> Column:
        cosine = F.cos(angle)
        terms = F.aggregate(
            F.when(F.floor((freedom - 1 - F.when(odd, 0).otherwise(1)) / 2) >= 1,
                   F.sequence(F.lit(1), F.floor((freedom - 1 - F.when(odd, 0).otherwise(1)) / 2).cast("int")))
            .otherwise(F.array().cast("array<int>")),
            F.struct(F.when(odd, 0.0).otherwise(1.0).alias("total"), F.lit(1.0).alias("term")),
            lambda acc, j: F.struct(
                (acc["total"] + acc["term"] * F.when(odd, F.when(j == 1, cosine).otherwise((2 * j - 2) / (2 * j - 1) * cosine * cosine))
                 .otherwise((2 * j - 1) / (2 * j) * cosine * cosine)).alias("total"),
                (acc["term"] * F.when(odd, F.when(j == 1, cosine).otherwise((2 * j - 2) / (2 * j - 1) * cosine * cosine))
                 .otherwise((2 * j - 1) / (2 * j) * cosine * cosine)).alias("term")))["total"]
        return F.when(odd, (angle + F.sin(angle) * terms) * (2 / math.pi)).otherwise(F.sin(angle) * terms)

    range_ = F.struct(F.lit(0.0).alias("low"), F.lit(math.pi / 2).alias("high"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(60)), range_, lambda r, _: F.when(
        inside((r["low"] + r["high"]) / 2) < 0.95,
        F.struct(((r["low"] + r["high"]) / 2).alias("low"), r["high"].alias("high")))
        .otherwise(F.struct(r["low"].alias("low"), ((r["low"] + r["high"]) / 2).alias("high"))))
    return F.when(freedom >= 1, F.sqrt(freedom) * F.tan(found["low"]))


def polynomial_trend(series: DataFrame, degree: int = 3) -> DataFrame:
    """Least-squares polynomial per regular series, with the 95 % band of the fitted curve.

    The polynomials orthogonal on the series' own months come from a three-term recurrence in windows; fit and leverage
    are sums over them. A series of `degree` months or fewer has no fit, one of a month more no band.
    """
    whole = Window.partitionBy("series_id")
    steps = series.select("series_id", "month", "y", F.count("*").over(whole).alias("n"),
                          F.row_number().over(_by_series()).alias("i"))
    rows = steps.withColumns({"t": F.coalesce(F.try_divide(2 * F.col("i") - F.col("n") - 1, F.col("n") - 1), F.lit(0.0)),
                              "p0": F.lit(1.0)})
    for k in range(1, degree + 1):
        term = F.col("t") * F.col(f"p{k - 1}")
        if k > 1:
            a, b = (F.sum(F.col(f"p{j}") * F.col(f"p{j}")).over(whole) for j in (k - 1, k - 2))
            term = term - F.col(f"p{k - 2}") * F.try_divide(a, b)
        rows = rows.withColumn(f"p{k}", term)
    names = [F.col(f"p{k}") for k in range(degree + 1)]
    squares = [F.sum(p * p).over(whole) for p in names]
    fitted = sum((p * F.try_divide(F.sum(F.col("y") * p).over(whole), q) for p, q in zip(names, squares)), F.lit(0.0))
    leverage = sum((F.try_divide(p * p, q) for p, q in zip(names, squares)), F.lit(0.0))
    rows = rows.select("series_id", "month", "y", "n", F.when(F.col("n") > degree, fitted).alias("fitted"),
                       leverage.alias("leverage"))
    rest = F.col("y") - F.col("fitted")
    freedom = (F.col("n") - degree - 1).cast("int")
    sigma = F.sqrt(F.sum(rest * rest).over(whole) / F.when(freedom > 0, freedom))
    half = t_quantile_975(freedom) * sigma * F.sqrt("leverage")
    return rows.select("series_id", "month", "y", "fitted", (F.col("fitted") - half).alias("low"),
                       (F.col("fitted") + half).alias("high"))
