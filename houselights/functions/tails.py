"""Tail probabilities as column expressions: chi-square and Student's t by incomplete gamma and beta functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from houselights.functions.arrays import let, places

_STEPS = 300
_TINY = 1e-300
_SHIFT = 10


def log_gamma(z: Column) -> Column:
    """Natural logarithm of the gamma function above zero: its asymptotic series ten places up, and back down."""
    def series(x: Column) -> Column:
        # Bernoulli numbers over 2k (2k - 1).
        terms = ((1 / 12, 1), (-1 / 360, 3), (1 / 1260, 5), (-1 / 1680, 7), (1 / 1188, 9), (-691 / 360360, 11))
        return (x - 0.5) * F.ln(x) - x + 0.5 * math.log(2 * math.pi) + sum((c / F.pow(x, F.lit(float(k))) for c, k in terms), F.lit(0.0))

    return let(z, lambda x: series(x + _SHIFT) - sum((F.ln(x + k) for k in range(_SHIFT)), F.lit(0.0)))


def _fraction(first_b: Column, step) -> Column:
    """A continued fraction by the modified Lentz method; step(i, b) gives the i-th numerator and denominator."""
    def safe(x: Column) -> Column:
        return F.when(F.abs(x) < _TINY, F.lit(_TINY)).otherwise(x)

    start = F.struct((1 / safe(first_b)).alias("d"), F.lit(1 / _TINY).alias("c"), (1 / safe(first_b)).alias("h"))

    def on(state: Column, i: Column) -> Column:
        a, b = step(i)
        return let(F.struct((1 / safe(a * state["d"] + b)).alias("d"), safe(b + a / state["c"]).alias("c")), lambda x: F.struct(
            x["d"].alias("d"), x["c"].alias("c"), (state["h"] * x["d"] * x["c"]).alias("h")))

    return F.aggregate(places(1, _STEPS), start, on)["h"]


def chi_square_tail(statistic: Column, degrees: Column) -> Column:
    """P(X > statistic): 1 at or below zero, NULL without degrees of freedom."""
    def of(v: Column) -> Column:
        a, x = v["a"], v["x"]
        scale = F.exp(a * F.ln(x) - x - log_gamma(a))
        series = F.aggregate(places(1, _STEPS), F.struct((1 / a).alias("term"), (1 / a).alias("sum")), lambda s, i: F.struct(
            (s["term"] * x / (a + i)).alias("term"), (s["sum"] + s["term"] * x / (a + i)).alias("sum")))["sum"]
        return F.when(x < a + 1, 1 - scale * series).otherwise(
            scale * _fraction(x + 1 - a, lambda i: (-i * (i - a), x + 1 - a + 2 * i)))

    return F.when((degrees > 0) & statistic.isNotNull(), F.when(statistic <= 0, 1.0).otherwise(
        let(F.struct((degrees / 2.0).alias("a"), (statistic / 2.0).alias("x")), of)))


def t_tail(statistic: Column, freedom: Column) -> Column:
    """P(|T| > |statistic|) of Student's t; NULL without degrees of freedom."""
    def part(a: Column, b: Column, x: Column) -> Column:
        """The incomplete beta function where its fraction converges fast."""
        def numerator(i: Column) -> Column:
            m = F.floor(i / 2)
            return F.when(i % 2 == 0, m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))).otherwise(
                -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)))
        log_scale = a * F.ln(x) + b * F.ln(1 - x) - log_gamma(a) - log_gamma(b) + log_gamma(a + b)
        return F.exp(log_scale) / a * _fraction(F.lit(1.0), lambda i: (numerator(i), F.lit(1.0)))

    def of(v: Column) -> Column:
        a, x, half = v["a"], v["x"], F.lit(0.5)
        return F.when(x >= 1, 1.0).when(x <= 0, 0.0).when(x < (a + 1) / (a + 2.5), part(a, half, x)).otherwise(
            1 - part(half, a, 1 - x))

    return F.when((freedom > 0) & statistic.isNotNull(), let(F.struct(
        (freedom / 2.0).alias("a"), (freedom / (freedom + statistic * statistic)).alias("x")), of))
