"""Least squares on cross products inside one row: matrices are flat arrays of doubles, solved by sweeping.

Sweeping a pivot solves for its predictor. After all predictors of [X y]'[X y] are swept, their block holds the inverse of
X'X, the last column the coefficients and the last cell the residual sum of squares. A pivot that has lost all but a
`tolerance` of its own square is aliased with those before it and left out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from houselights.functions.arrays import let, places

TOLERANCE = 1e-9


def row_of(cell: Column, width: int) -> Column:
    return F.floor(cell / width).cast("int")


def cross_products(rows: Column, width: int) -> Column:
    """The flat matrix Z'Z of an array of rows of `width` numbers each."""
    return F.transform(places(0, width * width - 1), lambda cell: F.aggregate(
        rows, F.lit(0.0), lambda done, z: done + F.get(z, row_of(cell, width)) * F.get(z, cell % width)))


def swept(matrix: Column, width: int, pivots: Column, tolerance: float = TOLERANCE) -> Column:
    """A struct of the matrix `a` after sweeping the pivots in order, and `done`, the pivots that were not aliased."""
    def step(state: Column, k: Column, scale: Column) -> Column:
        def pivot(a: Column, p: Column) -> Column:
            def cell(x: Column, at: Column) -> Column:
                i, j = row_of(at, width), at % width
                return (F.when((i == k) & (j == k), 1 / p).when(i == k, x / p).when(j == k, -x / p)
                        .otherwise(x - F.get(a, i * width + k) * F.get(a, k * width + j) / p))
            return F.struct(F.transform(a, cell).alias("a"), F.concat(state["done"], F.array(k)).alias("done"))

        return let(state["a"], lambda a: let(F.get(a, k * width + k), lambda p: F.when(
            p > tolerance * F.get(scale, k * width + k), pivot(a, p)).otherwise(state)))

    return let(matrix, lambda scale: F.aggregate(
        pivots, F.struct(scale.alias("a"), F.array().cast("array<int>").alias("done")), lambda s, k: step(s, k, scale)))


def coefficients(state: Column, width: int) -> Column:
    """The coefficients of all predictors of a swept matrix, zero for those that were not swept."""
    return F.transform(places(0, width - 2), lambda k: F.when(
        F.array_contains(state["done"], k), F.get(state["a"], k * width + width - 1)).otherwise(0.0))
