"""Exponential smoothing whose form is chosen for every series: additive or relative errors, no, straight or damped trend,
no, additive or multiplicative season.

Errors of both kinds follow from one fold of the series into level, trend, twelve season values and sums, so nine folds
serve fifteen forms. Weights come from a grid and two finer rounds around the best point of each form, each an exploded
table of points that partitions deal with on their own. The form with the least corrected information criterion wins.

Weights are held as shares, so that every point is admissible: alpha, beta / alpha, gamma / (1 - alpha), and the damping.
Series under two years have no season; relative errors need values above zero. One with too few months for the criterion
is carried on at its level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from houselights.functions.arrays import let, places, total
from houselights.models import series as s

SEASON = s.SEASON
ERRORS, TRENDS, SEASONS = ("A", "M"), ("N", "A", "Ad"), ("N", "A", "M")
LEVEL_SHARES = (0.02, 0.1, 0.25, 0.45, 0.7, 0.9)
SHARES = (0.02, 0.15, 0.5)
DAMPING = (0.85, 0.96)
#: Steps of the finer rounds: of the shares, and of the damping.
ROUNDS = ((0.08, 0.04), (0.03, 0.015))
LEAST_SHARE, LEAST_DAMPING, MOST_DAMPING = 0.001, 0.8, 0.98
#: Months behind the start values of a series without season.
FIRST = 6
_TINY = 1e-12


def _points(listed: DataFrame) -> DataFrame:
    """Every series with all points (trend, season, a, b, g, phi) of the first round; a share that a form lacks is zero."""
    def one_of(values: tuple, needed: Column, other: float) -> Column:
        return F.explode(F.when(needed, F.array(*map(F.lit, values))).otherwise(F.array(F.lit(other))))

    rows = listed.withColumn("trend", F.explode(places(0, 2))).withColumn("season", F.explode(
        F.when(F.col("years") & F.col("positive"), places(0, 2)).when(F.col("years"), places(0, 1)).otherwise(places(0, 0))))
    rows = rows.withColumn("a", F.explode(F.array(*map(F.lit, LEVEL_SHARES))))
    rows = rows.withColumn("b", one_of(SHARES, F.col("trend") > 0, 0.0)).withColumn("g", one_of(SHARES, F.col("season") > 0, 0.0))
    return rows.withColumn("phi", one_of(DAMPING, F.col("trend") == 2, 1.0))


def _listed(series: DataFrame) -> DataFrame:
    """One row per series: values, start values of level and trend, and of both kinds of season from the first two years."""
    rows = series.groupBy("series_id").agg(s._values().alias("ys"), F.max("month").alias("last_month"),
                                           (F.min("y") > 0).alias("positive"))
    n = F.size("ys")

    def mean(first: int, months: int | Column) -> Column:
        return F.try_divide(total(F.slice("ys", first, months)), F.lit(months) if isinstance(months, int) else months)

    years = n >= 2 * SEASON
    few = F.least(n, F.lit(FIRST))
    rows = rows.withColumns({"n": n, "years": years, "flat": F.when(years, mean(1, SEASON)).otherwise(mean(1, few))})
    slope = F.when(years, (mean(SEASON + 1, SEASON) - F.col("flat")) / SEASON).otherwise(F.coalesce(
        F.try_divide(F.get("ys", few - 1) - F.get("ys", F.lit(0)), few - 1), F.lit(0.0)))
    rows = rows.withColumn("slope", slope)
    rows = rows.withColumn("start", F.when(F.col("years"), F.col("flat") - (SEASON + 1) / 2 * F.col("slope")).otherwise(
        F.get("ys", F.lit(0)) - F.col("slope")))

    def line(i: Column) -> Column:
        return F.col("start") + F.col("slope") * (i + 1)

    def both(of) -> Column:
        return F.transform(places(0, SEASON - 1), lambda i: (of(i) + of(i + SEASON)) / 2)

    rows = rows.withColumns({
        "added": F.when(F.col("years"), both(lambda i: F.get("ys", i) - line(i))),
        "times": F.when(F.col("years") & F.col("positive"), both(lambda i: F.try_divide(F.get("ys", i), line(i))))})
    return rows.withColumns({
        "added": F.transform("added", lambda x: x - total(F.col("added")) / SEASON),
        "times": F.transform("times", lambda x: F.try_divide(x * SEASON, total(F.col("times"))))})


def _folded(rows: DataFrame) -> DataFrame:
    """Rows with a point each to `end`: the last state and the sums of errors."""
    nothing = F.array(*[F.lit(0.0)] * SEASON)
    rows = rows.withColumns({"alpha": F.col("a"), "beta": F.col("a") * F.col("b"), "gamma": (1 - F.col("a")) * F.col("g")})
    times, straight = F.col("season") == 2, F.col("trend") > 0
    start = F.struct(
        F.when(straight, F.col("start")).otherwise(F.col("flat")).alias("level"),
        F.when(straight, F.col("slope")).otherwise(0.0).alias("slope"),
        F.when(times, F.col("times")).when(F.col("season") == 1, F.col("added")).otherwise(nothing).alias("effects"),
        *[F.lit(0.0).alias(name) for name in ("sse", "srel", "slog", "se", "sae", "sape")], F.lit(1e300).alias("lowest"))

    def updated(state: Column, y: Column, x: Column) -> Column:
        """x: what is carried on, and the fitted value."""
        base, effect, error = x["base"], x["effect"], y - x["fitted"]
        below = F.when(times, F.try_divide(error, effect)).otherwise(error)
        moved = F.when(F.col("season") == 0, 0.0).when(times, effect + F.col("gamma") * F.try_divide(error, base)).otherwise(
            effect + F.col("gamma") * error)
        # The sums never become NULL: what divides by zero is left out here and ruled out by `lowest` or at the end.
        relative = F.coalesce(F.try_divide(error, x["fitted"]), F.lit(0.0))
        return F.struct(
            (base + F.col("alpha") * below).alias("level"), (x["carried"] + F.col("beta") * below).alias("slope"),
            F.concat(F.slice(state["effects"], 2, SEASON - 1), F.array(moved)).alias("effects"),
            (state["sse"] + error * error).alias("sse"), (state["srel"] + relative * relative).alias("srel"),
            (state["slog"] + F.coalesce(F.ln(F.abs(x["fitted"])), F.lit(0.0))).alias("slog"), (state["se"] + error).alias("se"),
            (state["sae"] + F.abs(error)).alias("sae"),
            (state["sape"] + F.coalesce(F.abs(F.try_divide(error, y)), F.lit(0.0))).alias("sape"),
            F.least(state["lowest"], x["fitted"]).alias("lowest"))

    def step(state: Column, y: Column) -> Column:
        known = F.struct((F.col("phi") * state["slope"]).alias("carried"), F.get(state["effects"], F.lit(0)).alias("effect"))

        def ahead(x: Column) -> Column:
            base = state["level"] + x["carried"]
            return F.struct(x["carried"].alias("carried"), x["effect"].alias("effect"), base.alias("base"), F.when(
                times, base * x["effect"]).otherwise(base + x["effect"]).alias("fitted"))
        return let(known, lambda x: let(ahead(x), lambda z: updated(state, y, z)))

    return rows.withColumn("end", F.aggregate("ys", start, step))


def _judged(rows: DataFrame, keep: list[str]) -> DataFrame:
    """The best point of every (series, error, trend, season), of equal ones the least."""
    end, n = F.col("end"), F.col("n")
    plain = F.when(F.col("season") < 2, n * F.ln(F.greatest(end["sse"], _TINY * n)))
    relative = F.when(F.col("positive") & (end["lowest"] > 0), n * F.ln(F.greatest(end["srel"], _TINY * n)) + 2 * end["slog"])
    kinds = F.array(F.struct(F.lit(0).alias("error"), plain.alias("fit")), F.struct(F.lit(1).alias("error"), relative.alias("fit")))
    kept = [*keep, "a", "b", "g", "phi", "alpha", "beta", "gamma", "end"]
    return (_folded(rows).withColumn("kind", F.explode(kinds)).where("kind.fit is not null and not isnan(kind.fit)")
            .groupBy("series_id", F.col("kind.error").alias("error"), "trend", "season")
            .agg(F.min_by(F.struct(*kept, F.col("kind.fit").alias("fit")), F.struct("kind.fit", "a", "b", "g", "phi")).alias("best"))
            .select("series_id", "error", "trend", "season", "best.*"))


def _near(rows: DataFrame, share: float, damping: float) -> DataFrame:
    """The points a step around each row's own."""
    def steps(needed: Column) -> Column:
        return F.when(needed, F.array(*map(F.lit, (-1, 0, 1)))).otherwise(F.array(F.lit(0)))

    def moved(name: str, by: Column, needed: Column, size: float, low: float, high: float) -> Column:
        return F.when(needed, F.greatest(F.lit(low), F.least(F.lit(high), F.col(name) + by * size))).otherwise(F.col(name))

    needs = {"a": F.lit(True), "b": F.col("trend") > 0, "g": F.col("season") > 0, "phi": F.col("trend") == 2}
    for name, needed in needs.items():
        rows = rows.withColumn(f"_{name}", F.explode(steps(needed)))
    ends = {name: (share, LEAST_SHARE, 1 - LEAST_SHARE) for name in "abg"} | {"phi": (damping, LEAST_DAMPING, MOST_DAMPING)}
    return rows.withColumns({name: moved(name, F.col(f"_{name}"), needs[name], *ends[name]) for name in needs})


def _fitted(series: DataFrame) -> DataFrame:
    """The chosen form of every series with weights, last state and sums of errors."""
    listed = _listed(series)
    keep = ["ys", "last_month", "positive", "n", "years", "flat", "slope", "start", "added", "times"]
    rows = _judged(_points(listed), keep)
    for share, damping in ROUNDS:
        # Errors of one form are refined apart: a fold serves the kind whose best point it starts from.
        around = _near(rows, share, damping).withColumnRenamed("error", "own")
        rows = _judged(around.withColumn("series_id", F.struct("series_id", "own")).drop("end", "fit"), keep).where(
            "error = series_id.own").withColumn("series_id", F.col("series_id.series_id"))
    trend, season, n = (F.col("trend") > 0).cast("int"), (F.col("season") > 0).cast("int"), F.col("n")
    k = 3 + 2 * trend + 12 * season + (F.col("trend") == 2).cast("int")
    aicc = F.when(n - k > 1, F.col("fit") + 2 * k + 2 * k * (k + 1) / (n - k - 1))
    rows = rows.withColumns({"k": k, "aicc": aicc})
    order = F.struct(F.col("aicc").isNull(), F.coalesce("aicc", F.col("k").cast("double")), "error", "trend", "season")
    best = rows.groupBy("series_id").agg(F.min_by(F.struct(
        *[x for x in rows.columns if x != "series_id"]), order).alias("m")).select("series_id", "m.*")
    pick = lambda names, at: F.element_at(F.array(*map(F.lit, names)), F.col(at) + 1)
    form = F.concat(F.lit("ETS("), pick(ERRORS, "error"), F.lit(","), pick(TRENDS, "trend"), F.lit(","), pick(SEASONS, "season"),
                    F.lit(")"))
    sums = F.when(F.col("error") == 0, F.col("end.sse")).otherwise(F.col("end.srel"))
    return best.withColumns({"form": form, "variance": F.try_divide(sums, F.when(n >= F.col("k"), n - F.col("k") + 1))})


def choose_smoothing(series: DataFrame) -> DataFrame:
    """Form, weights, criterion and errors of the one-step forecasts of every series; `mape` is NULL where a value is zero."""
    used = {"beta": F.col("trend") > 0, "gamma": F.col("season") > 0, "phi": F.col("trend") == 2}
    n = F.col("n")
    return _fitted(series).select(
        "series_id", "form", "alpha", *[F.when(ok, F.col(name)).alias(name) for name, ok in used.items()], "aicc",
        n.cast("bigint").alias("n"), (F.col("end.se") / n).alias("me"), F.sqrt(F.col("end.sse") / n).alias("rmse"),
        (F.col("end.sae") / n).alias("mae"), F.when(
            ~F.exists("ys", lambda y: y == 0), 100 * F.col("end.sape") / n).alias("mape"))


def smoothing_forecast(series: DataFrame, horizon: int = 12) -> DataFrame:
    """The next months by the chosen form of every series, with 95 % intervals.

    The variance of a relative-error form follows from that of its mean path; a multiplicative season scales it.
    """
    models = _fitted(series)
    phi = F.col("phi")
    carried = F.aggregate(places(1, horizon), F.array(F.lit(0.0)), lambda done, h: F.concat(
        done, F.array(F.element_at(done, -1) + F.pow(phi, h))))
    models = models.withColumn("carried", carried)
    times = F.col("season") == 2

    def base(h: Column) -> Column:
        return F.col("end.level") + F.get("carried", h) * F.col("end.slope")

    def effect(h: Column) -> Column:
        return F.get("end.effects", (h - 1) % SEASON)

    def mean(h: Column) -> Column:
        return F.when(times, base(h)).otherwise(base(h) + effect(h))

    def weight(j: Column) -> Column:
        return F.col("alpha") + F.col("beta") * F.get("carried", j) + F.when(
            (F.col("season") == 1) & (j % SEASON == 0), F.col("gamma")).otherwise(0.0)

    steps = places(1, horizon)
    models = models.withColumns({"means": F.transform(steps, mean), "weights": F.transform(steps, weight)})
    # The expected square of the mean path, month by month.
    squares = F.aggregate(steps, F.array().cast("array<double>"), lambda done, h: F.concat(done, F.array(
        F.pow(F.get("means", h - 1), F.lit(2.0)) + F.col("variance") * total(F.transform(places(1, h - 1), lambda j: F.pow(
            F.get("weights", j - 1), F.lit(2.0)) * F.get(done, h - j - 1))))))
    models = models.withColumn("squares", squares).withColumn("h", F.explode(steps))
    h, variance = F.col("h"), F.col("variance")
    added = variance * (1 + total(F.transform(places(1, h - 1), lambda j: F.pow(F.get("weights", j - 1), F.lit(2.0)))))
    square, middle = F.get("squares", h - 1), F.get("means", h - 1)
    lasting = F.pow(1 + F.col("gamma") * F.col("gamma") * variance, F.floor((h - 1) / SEASON))
    relative = square * (1 + variance) * F.when(times, lasting).otherwise(1.0) - middle * middle
    scale = F.when(times, effect(h)).otherwise(1.0)
    half = s.Z_95 * scale * F.sqrt(F.when(F.col("error") == 0, added).otherwise(F.greatest(relative, F.lit(0.0))))
    return models.select("series_id", F.add_months("last_month", h).alias("month"), "form", (middle * scale).alias("forecast"),
                         (middle * scale - half).alias("low"), (middle * scale + half).alias("high"))
