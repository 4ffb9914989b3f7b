"""Autoregressive models with shock terms whose orders are chosen for every series.

Differences come first: a seasonal one where month effects carry most of what the trend leaves, then plain ones until a
test no longer rejects a steady level. Shocks are estimated by a long autoregression, and the series is regressed on its
own lags and on theirs (two-stage regression). All orders up to three, with or without the lag of a year, are fitted from
one matrix of cross products, over the same months. Among models that forget their past and whose corrected information
criterion is within MARGIN of the smallest, which the data do not tell apart, the one with fewest terms wins.

A series is one row with an array, so all of it is one shuffle and no driver loop, however many series there are. One that
is too short or too even for lags is carried on at the mean of its differences.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from houselights.functions.arrays import let, places, total
from houselights.models import series as s
from houselights.models.sweep import coefficients, cross_products, swept

SEASON = s.SEASON
LONG = SEASON + 1
#: Seasonal strength from which a series is differenced by a year, and the least number of months for it.
STRENGTH, SEASONAL_MONTHS = 0.64, 4 * SEASON
LEVEL_5 = 0.463  # Fixed value: 5 % point of the level-stationarity statistic.
MOST, MOST_TERMS = 3, 5
#: Months that a choice among orders needs, after differences and lags.
LEAST = 20
#: After MEMORY months a shock must have faded to FADED.
MEMORY, FADED = 120, 0.35
MARGIN = 2.0

#: All (p, q, P, Q), fewest terms first.
ORDERS = sorted((o for o in product(range(MOST + 1), range(MOST + 1), (0, 1), (0, 1)) if sum(o) <= MOST_TERMS),
                key=lambda o: (sum(o), o))
_WIDTH = 2 * MOST + 4
#: Columns of the second regression: constant, own lags 1 2 3 12, shock lags 1 2 3 12, the value.
LAGS = (*range(1, MOST + 1), SEASON)


def pivots(p: int, q: int, sp: int, sq: int) -> list[int]:
    """The columns of the second regression that belong to an order."""
    own, shock = len(LAGS), 1 + len(LAGS)
    return [*range(1, p + 1), *([own] if sp else []), *range(shock, shock + q), *([shock + MOST] if sq else [])]


def level_statistic(x: Column) -> Column:
    """Sum of squared partial sums of the deviations from the mean, against the long-run variance."""
    n = F.size(x)

    def of(c: Column) -> Column:
        partial = F.aggregate(c, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("ss")), lambda a, v: F.struct(
            (a["s"] + v).alias("s"), (a["ss"] + (a["s"] + v) * (a["s"] + v)).alias("ss")))["ss"]
        reach = F.floor(3 * F.sqrt(n.cast("double")) / 13).cast("int")
        shared = total(F.transform(places(1, reach), lambda j: 2 * (1 - j / (reach + 1)) * total(
            F.transform(places(j, n - 1), lambda i: F.get(c, i) * F.get(c, i - j)))))
        return F.try_divide(partial, n * (total(F.transform(c, lambda v: v * v)) + shared))

    return let(F.try_divide(total(x), n), lambda mean: let(F.transform(x, lambda v: v - mean), of))


def differenced(x: Column, lag: int) -> Column:
    return F.transform(places(lag, F.size(x) - 1), lambda i: F.get(x, i) - F.get(x, i - lag))


def _listed(series: DataFrame) -> DataFrame:
    """One row per series: values in month order, strength and differences (d plain, sd seasonal), `w` after them."""
    part = s.decompose(series)
    rest = F.try_divide(F.var_pop("remainder"), F.var_pop(F.col("seasonal") + F.col("remainder")))
    rows = part.groupBy("series_id").agg(s._values().alias("ys"), F.max("month").alias("last_month"),
                                         F.greatest(F.lit(0.0), 1 - rest).alias("strength"))
    seasonal = (F.size("ys") >= SEASONAL_MONTHS) & (F.coalesce("strength", F.lit(0.0)) > STRENGTH)
    rows = rows.withColumn("sd", seasonal.cast("int"))
    base = F.when(F.col("sd") == 1, differenced(F.col("ys"), SEASON)).otherwise(F.col("ys"))

    def unsteady(x: Column) -> Column:
        return (F.size(x) >= SEASON) & (F.coalesce(level_statistic(x), F.lit(0.0)) > LEVEL_5)

    def choose(x: Column) -> Column:
        def once(x1: Column) -> Column:
            return F.when(~unsteady(x1), F.struct(F.lit(1).alias("d"), x1.alias("w"))).otherwise(
                F.struct(F.lit(2).alias("d"), differenced(x1, 1).alias("w")))
        return F.when(~unsteady(x), F.struct(F.lit(0).alias("d"), x.alias("w"))).otherwise(let(differenced(x, 1), once))

    return rows.withColumn("_c", let(base, choose)).select(
        "series_id", "ys", "last_month", "strength", "sd", F.col("_c.d").alias("d"), F.col("_c.w").alias("w"))


def _scaled(rows: DataFrame) -> DataFrame:
    """`v`: the differenced values around their mean where a constant is allowed, in units of their spread."""
    n = F.size("w")
    rows = rows.withColumn("constant", F.col("d") + F.col("sd") <= 1)
    rows = rows.withColumn("centre", F.when(F.col("constant"), F.try_divide(total(F.col("w")), n)).otherwise(0.0))
    spread = F.sqrt(F.try_divide(total(F.transform("w", lambda x: (x - F.col("centre")) * (x - F.col("centre")))), n))
    rows = rows.withColumn("spread", spread)
    return rows.withColumn("v", F.transform("w", lambda x: F.try_divide(x - F.col("centre"), F.col("spread"))))


def _shocks(v: Column, constant: Column) -> Column:
    """Residuals of the long autoregression, zero in the months that it has no lags for."""
    width, n = LONG + 2, F.size(v)

    def rows(first: int) -> Column:
        return F.transform(places(first, n - 1), lambda t: F.array(
            F.lit(1.0), *[F.get(v, t - k) for k in range(1, LONG + 1)], F.get(v, t)))

    def rest(b: Column) -> Column:
        return F.transform(rows(LONG), lambda z: F.get(z, F.lit(LONG + 1)) - total(
            F.transform(b, lambda x, k: x * F.get(z, k))))

    chosen = F.when(constant, places(0, LONG)).otherwise(places(1, LONG))
    fit = let(rows(LONG), lambda z: let(swept(cross_products(z, width), width, chosen), lambda a: coefficients(a, width)))
    return let(fit, lambda b: F.concat(F.array_repeat(F.lit(0.0), LONG), rest(b)))


def _response(own: list[Column], months: int) -> Column:
    """What is left of a shock after each month under lags (1, 2, 3, 12) with these weights."""
    start = F.array(*[F.lit(0.0)] * (SEASON - 1), F.lit(1.0))
    return F.aggregate(places(1, months), start, lambda done, _: F.concat(F.slice(done, 2, SEASON - 1), F.array(
        sum((w * F.get(done, F.lit(SEASON - k)) for w, k in zip(own, LAGS)), F.lit(0.0)))))


def _fades(weights: Column, first: int, sign: int) -> Column:
    """No value of the last year of MEMORY is above FADED."""
    own = [sign * F.get(weights, F.lit(first + k)) for k in range(len(LAGS))]
    return F.coalesce(F.forall(_response(own, MEMORY), lambda x: F.abs(x) <= FADED), F.lit(False))


def _fits(v: Column, e: Column, constant: Column) -> Column:
    """The models worth a choice, as structs that sort by number of terms and criterion."""
    n = F.size(v)
    own, shock = ([(x, k) for k in LAGS] for x in (v, e))
    rows = F.transform(places(LONG + SEASON, n - 1), lambda t: F.array(
        F.lit(1.0), *[F.get(x, t - k) for x, k in (*own, *shock)], F.get(v, t)))
    months = (n - LONG - SEASON).cast("double")
    grid = F.array(*[F.struct(*[F.lit(x).alias(name) for x, name in zip(o, ("p", "q", "sp", "sq"))], F.array(
        *[F.lit(x) for x in pivots(*o)]).cast("array<int>").alias("pivots"), F.lit(at).alias("at"),
        F.lit(sum(o)).alias("terms")) for at, o in enumerate(ORDERS)])

    def fit(order: Column, matrix: Column) -> Column:
        chosen = F.when(constant, F.concat(F.array(F.lit(0)), order["pivots"])).otherwise(order["pivots"])

        def judged(state: Column) -> Column:
            k = (F.size(state["done"]) + 1).cast("double")
            rss = F.greatest(F.get(state["a"], F.lit(_WIDTH * _WIDTH - 1)), F.lit(1e-12))
            return F.struct(
                order["terms"].alias("terms"),
                (months * F.ln(rss / months) + 2 * k + 2 * k * (k + 1) / (months - k - 1)).alias("aicc"), order["at"].alias("at"),
                *[order[x].alias(x) for x in ("p", "q", "sp", "sq")], coefficients(state, _WIDTH).alias("b"),
                (rss / (months - k + 1)).alias("variance"))

        return let(swept(matrix, _WIDTH, chosen), judged)

    fits = let(cross_products(rows, _WIDTH), lambda m: F.transform(grid, lambda o: fit(o, m)))
    sound = F.filter(fits, lambda f: _fades(f["b"], 1, 1) & _fades(f["b"], 1 + len(LAGS), -1))
    return let(sound, lambda f: let(F.array_min(F.transform(f, lambda x: x["aicc"])), lambda least: F.filter(
        f, lambda x: x["aicc"] <= least + MARGIN)))


def _models(series: DataFrame) -> DataFrame:
    rows = _scaled(_listed(series))
    long = (F.size("w") >= LONG + SEASON + LEAST) & (F.col("spread") > 0)
    rows = rows.withColumn("e", F.when(long, _shocks(F.col("v"), F.col("constant"))))
    best = F.when(long, F.array_min(_fits(F.col("v"), F.col("e"), F.col("constant"))))
    n = F.size("w")
    plain = F.struct(
        F.lit(0).alias("terms"), F.lit(None).cast("double").alias("aicc"), F.lit(0).alias("at"), *[F.lit(0).alias(x) for x in ("p", "q", "sp", "sq")],
        F.array_repeat(F.lit(0.0), _WIDTH - 1).alias("b"), F.when(n > 1, n / (n - 1)).alias("variance"))
    return rows.withColumn("m", F.coalesce(best, plain))


def _name() -> Column:
    return F.format_string("(%d,%d,%d)(%d,%d,%d)[12]", "m.p", "d", "m.q", "m.sp", "sd", "m.sq")


def choose_orders(series: DataFrame) -> DataFrame:
    """Orders of every series as (p,d,q)(P,D,Q)[12], whether a constant was fitted, criterion and residual deviation; NULL
    where the series is too short for a choice."""
    return _models(series).select(
        "series_id", _name().alias("orders"), "constant", F.col("strength").alias("seasonal_strength"), F.col("m.aicc").alias("aicc"),
        (F.sqrt("m.variance") * F.col("spread")).alias("residual_sd"))


def _undone(ys: Column) -> Column:
    """What the differences take from earlier values of a list."""
    def back(k: int) -> Column:
        return F.get(ys, F.size(ys) - k)

    d, sd = F.col("d"), F.col("sd") == 1
    plain = F.when(d == 0, 0.0).when(d == 1, back(1)).otherwise(2 * back(1) - back(2))
    crossed = F.when(d == 0, back(12)).when(d == 1, back(12) - back(13)).otherwise(back(12) - 2 * back(13) + back(14))
    return plain + F.when(sd, crossed).otherwise(0.0)


def _step(state: Column, shock: Column, constant: bool) -> Column:
    """One month on: the value after differences, its shock, and the value itself."""
    b = F.col("m.b")

    def back(name: str, k: int) -> Column:
        return F.coalesce(F.get(state[name], F.size(state[name]) - k), F.lit(0.0))

    v = sum((F.get(b, F.lit(1 + i)) * back("v", k) + F.get(b, F.lit(1 + len(LAGS) + i)) * back("e", k)
             for i, k in enumerate(LAGS)), shock)
    if constant:
        v = v + F.get(b, F.lit(0))
        y = v * F.coalesce("spread", F.lit(0.0)) + F.coalesce("centre", F.lit(0.0))
    else:
        y = v
    return F.struct(F.concat(state["v"], F.array(v)).alias("v"), F.concat(state["e"], F.array(shock)).alias("e"),
                    F.concat(state["y"], F.array(y + _undone(state["y"]))).alias("y"))


def auto_order_forecast(series: DataFrame, horizon: int = 12) -> DataFrame:
    """The next months by the chosen model of every series, with 95 % intervals and its orders."""
    none = F.array_repeat(F.lit(0.0), 14)
    models = _models(series)
    known = F.when(F.col("spread") > 0, F.col("v")).otherwise(none)
    path = F.aggregate(places(1, horizon), F.struct(
        known.alias("v"), F.coalesce(F.col("e"), none).alias("e"), F.col("ys").alias("y")),
        lambda state, _: _step(state, F.lit(0.0), True))["y"]
    answer = F.aggregate(places(1, horizon), F.struct(none.alias("v"), none.alias("e"), none.alias("y")),
                         lambda state, h: _step(state, F.when(h == 1, 1.0).otherwise(0.0), False))["y"]
    models = models.withColumns({"path": F.slice(path, F.size("ys") + 1, horizon), "answer": F.slice(answer, 15, horizon)})
    ahead = F.explode(places(1, horizon))
    spread = F.sqrt(total(F.transform(F.slice("answer", 1, F.col("h")), lambda x: x * x)))
    half = s.Z_95 * F.sqrt("m.variance") * F.col("spread") * spread
    forecast = F.get("path", F.col("h") - 1)
    return models.withColumn("h", ahead).select(
        "series_id", F.add_months("last_month", F.col("h")).alias("month"), _name().alias("orders"), forecast.alias("forecast"),
        (forecast - half).alias("low"), (forecast + half).alias("high"))
