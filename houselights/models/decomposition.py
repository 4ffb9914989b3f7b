"""Trend and season by local regression, for many series at once.

A periodic season is the mean of each calendar month of what the trend leaves, around zero; the trend is a straight line
fitted at every month to its neighbours, weighted by the tricube of their distance. Both are worked out in turn. With
`robust`, months that fit badly lose weight between the turns.

A series is one row with arrays: neighbourhoods are folds of a fixed width, and the turns are a fold as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from houselights.functions.arrays import let, places, total
from houselights.models import series as s

SEASON = s.SEASON
#: Neighbours behind the trend: the least odd number from one and a half seasons up.
WIDTH = 19
INNER, OUTER = 2, 15
ROBUST_INNER = 1


def _tricube(distance: Column, reach: Column) -> Column:
    """Neighbours up to a thousandth of the reach count whole, from 0.999 of it not at all."""
    share = distance / reach
    return F.when(distance <= 0.001 * reach, 1.0).when(distance <= 0.999 * reach, F.pow(
        1 - F.pow(share, F.lit(3.0)), F.lit(3.0))).otherwise(0.0)


def local_line(ys: Column, weights: Column, width: int = WIDTH) -> Column:
    """At every place the value of the line through its `width` nearest neighbours; at the ends they lie on one side."""
    n = F.size(ys)
    last = n - 1

    def at(i: Column) -> Column:
        first = F.greatest(F.lit(0), F.least(i - width // 2, n - width))
        end = F.least(last, first + width - 1)
        reach = F.greatest(i - first, end - i) + F.when(n < width, F.floor((F.lit(width) - n) / 2)).otherwise(0)

        def fitted(w: Column) -> Column:
            def over(of) -> Column:
                return total(F.transform(w, lambda x, k: x * of(k + first)))
            whole = total(w)
            return let(F.try_divide(over(lambda j: j.cast("double")), whole), lambda middle: let(
                F.try_divide(over(lambda j: (j - middle) * (j - middle)), whole), lambda spread: F.coalesce(F.when(
                    F.sqrt(spread) > 0.001 * last, F.try_divide(over(lambda j: (1 + (i - middle) / spread * (j - middle)) * F.get(
                        ys, j)), whole)).otherwise(F.try_divide(over(lambda j: F.get(ys, j)), whole)), F.get(ys, i))))

        near = F.transform(places(first, end), lambda j: F.get(weights, j) * _tricube(F.abs(i - j), reach))
        return let(near, fitted)

    return F.transform(places(0, last), at)


def _season(rest: Column, weights: Column) -> Column:
    """The twelve month effects around zero, by place in the series modulo the season."""
    def mean(m: Column) -> Column:
        mine = F.sequence(m, F.size(rest) - 1, F.lit(SEASON))
        weight = total(F.transform(mine, lambda j: F.get(weights, j)))
        return F.coalesce(F.try_divide(total(F.transform(mine, lambda j: F.get(weights, j) * F.get(rest, j))), weight), F.lit(0.0))

    return let(F.transform(places(0, SEASON - 1), mean), lambda all_: F.transform(all_, lambda x: x - total(all_) / SEASON))


def _less(a: Column, b: Column) -> Column:
    return F.transform(a, lambda x, i: x - F.get(b, i))


def _spread_out(effects: Column, n: Column) -> Column:
    return F.transform(places(0, n - 1), lambda i: F.get(effects, i % SEASON))


def _bisquare(rest: Column) -> Column:
    """Weight of every month by its remainder, against six times the median one."""
    size = F.transform(rest, F.abs)
    n = F.size(rest)

    def weigh(ordered: Column) -> Column:
        reach = 3 * (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int")))
        return let(reach, lambda h: F.transform(size, lambda r: F.when(r <= 0.001 * h, 1.0).when(r <= 0.999 * h, F.pow(
            1 - F.pow(r / h, F.lit(2.0)), F.lit(2.0))).otherwise(0.0)))

    return let(F.array_sort(size), weigh)


def local_decomposition(series: DataFrame, robust: bool = False, width: int = WIDTH) -> DataFrame:
    """series_id, month, y, trend, seasonal and remainder, defined in every month. A series under two years has no season:
    its trend is the local line through the values."""
    ys, n = F.col("ys"), F.size("ys")
    years = n >= 2 * SEASON
    inner, outer = (ROBUST_INNER, OUTER) if robust else (INNER, 0)
    zero = F.transform(ys, lambda _: F.lit(0.0))
    one = F.transform(ys, lambda _: F.lit(1.0))

    def turn(state: Column, k: Column) -> Column:
        def with_season(season: Column) -> Column:
            return let(local_line(_less(ys, season), state["weights"], width), lambda trend: F.struct(
                trend.alias("trend"), season.alias("season"), F.when(
                    F.lit(robust) & (k % inner == 0) & (k < inner * (outer + 1)),
                    _bisquare(_less(_less(ys, season), trend))).otherwise(state["weights"]).alias("weights")))

        season = F.when(years, _spread_out(_season(_less(ys, state["trend"]), state["weights"]), n)).otherwise(zero)
        return let(season, with_season)

    start = F.struct(zero.alias("trend"), zero.alias("season"), one.alias("weights"))
    rows = series.groupBy("series_id").agg(
        F.sort_array(F.collect_list(F.struct("month", "y"))).alias("points")).withColumn("ys", F.transform(
            "points", lambda p: p["y"]))
    rows = rows.withColumn("parts", F.aggregate(places(1, inner * (outer + 1)), start, turn))
    each = F.transform(places(0, n - 1), lambda i: F.struct(
        F.get("points", i)["month"].alias("month"), F.get(ys, i).alias("y"), F.get("parts.trend", i).alias("trend"),
        F.get("parts.season", i).alias("seasonal")))
    return rows.select("series_id", F.explode(each).alias("p")).select(
        "series_id", "p.*", (F.col("p.y") - F.col("p.trend") - F.col("p.seasonal")).alias("remainder"))
