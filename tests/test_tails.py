"""Tail probabilities against textbook points and known integrals."""

import math

import pytest
from pyspark.sql import functions as F

from houselights.functions import tails


def values(spark, expression, rows, names="x double, n double"):
    return [r[0] for r in spark.createDataFrame(rows, names).select(expression.alias("p")).collect()]


def test_log_gamma(spark):
    points = [0.5, 1.0, 2.0, 3.5, 10.0, 171.0, 5000.5]
    got = values(spark, tails.log_gamma(F.col("x")), [(x, 0.0) for x in points])
    assert got == pytest.approx([math.lgamma(x) for x in points], rel=1e-12, abs=1e-12)


def test_chi_square_points(spark):
    """5 % and 1 % points as printed in tables, closed forms for even degrees, and the ends."""
    rows = [(3.841, 1.0), (5.991, 2.0), (7.815, 3.0), (9.488, 4.0), (18.307, 10.0), (31.410, 20.0), (6.635, 1.0), (23.209, 10.0)]
    got = values(spark, tails.chi_square_tail(F.col("x"), F.col("n")), rows)
    assert got == pytest.approx([0.05] * 6 + [0.01] * 2, abs=2e-5)
    exact = [(0.3, 2.0), (5.0, 2.0), (2.0, 4.0), (80.0, 4.0), (700.0, 2.0)]
    want = [math.exp(-x / 2) * (1 + x / 2 if n == 4 else 1) for x, n in exact]
    assert values(spark, tails.chi_square_tail(F.col("x"), F.col("n")), exact) == pytest.approx(want, rel=1e-11)
    odd = [0.1, 1.0, 4.0, 30.0]
    assert values(spark, tails.chi_square_tail(F.col("x"), F.lit(1)), [(x, 0.0) for x in odd]) == pytest.approx(
        [math.erfc(math.sqrt(x / 2)) for x in odd], rel=1e-11)
    assert values(spark, tails.chi_square_tail(F.col("x"), F.col("n")), [(0.0, 3.0), (-1.0, 3.0), (1.0, 0.0), (None, 3.0)]) == [
        1.0, 1.0, None, None]


def test_t_points(spark):
    rows = [(12.706, 1.0), (4.303, 2.0), (2.571, 5.0), (2.228, 10.0), (2.042, 30.0), (1.980, 120.0), (1.95996, 1e7), (-2.228, 10.0)]
    got = values(spark, tails.t_tail(F.col("x"), F.col("n")), rows)
    assert got == pytest.approx([0.05] * 8, abs=1e-4)
    # One and two degrees of freedom in closed form.
    points = [0.0, 0.01, 0.5, 3.0, 40.0]
    assert values(spark, tails.t_tail(F.col("x"), F.lit(1)), [(x, 0.0) for x in points]) == pytest.approx(
        [1 - 2 / math.pi * math.atan(x) for x in points], rel=1e-10)
    assert values(spark, tails.t_tail(F.col("x"), F.lit(2)), [(x, 0.0) for x in points]) == pytest.approx(
        [1 - x / math.sqrt(2 + x * x) for x in points], rel=1e-9)
    assert values(spark, tails.t_tail(F.col("x"), F.col("n")), [(1.0, 0.0), (None, 3.0)]) == [None, None]
