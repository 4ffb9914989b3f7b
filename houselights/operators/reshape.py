"""Pivot, unpivot, shares, totals and calendar spines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def pivot_fixed(df: DataFrame, keys: Sequence[str], column: str, values: Sequence[str] | dict[str, str],
                aggregate: Column, fill: float | None = None) -> DataFrame:
    """Long to wide over a stated value list: no extra job to find the values, and a fixed output schema."""
    names = values if isinstance(values, dict) else {v: v for v in values}
    wide = df.groupBy(*keys).pivot(column, list(names)).agg(aggregate)
    for value, name in names.items():
        if value != name:
            wide = wide.withColumnRenamed(value, name)
    return wide if fill is None else wide.fillna(fill, subset=list(names.values()))


def unpivot(df: DataFrame, keys: Sequence[str], values: Sequence[str], variable: str, value: str) -> DataFrame:
    return df.unpivot(list(keys), list(values), variable, value)


def share_of_total(df: DataFrame, value: str, within: Sequence[str], name: str) -> DataFrame:
    """Each row's part of its group total. Use on aggregated rows: a group must be small."""
    total = F.sum(value).over(Window.partitionBy(*within))
    return df.withColumn(name, F.try_divide(F.col(value).cast("double"), total.cast("double")))


def row_shares(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each column as its part of the row total; a missing part leaves the row's shares unknown."""
    total = sum((F.col(name) for name in columns[1:]), F.col(columns[0]))
    return df.withColumns({name: F.try_divide(F.col(name), total) for name in columns})


def with_total_rows(grouped: DataFrame, outer: Sequence[str], inner: str, measures: Sequence[str],
                    label: str = "Total") -> DataFrame:
    """Grouped rows plus one row per `outer` whose `inner` reads `label`.

    `measures` are additive counts and sums, so the totals come from the grouped rows and the raw rows are read once
    and never duplicated. Ratios belong after this step: in the total row they are then ratios of totals.
    """
    keys = [F.col(name) for name in outer]
    both = (grouped.groupingSets([[*keys, F.col(inner)], keys], *keys, F.col(inner))
            .agg(F.grouping(inner).alias("_total"), *[F.sum(name).alias(name) for name in measures]))
    return both.withColumn(inner, F.when(F.col("_total") == 1, label).otherwise(F.col(inner))).drop("_total")


def month_spine(spark: SparkSession, first: str, last: str, name: str = "month") -> DataFrame:
    """Every month start from `first` to `last` (a calendar table, bounded by the range)."""
    months = F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("INTERVAL 1 MONTH"))
    return spark.range(1).select(F.explode(months).alias(name))


def fill_months(df: DataFrame, first: str, last: str, values: Sequence[str], name: str = "month") -> DataFrame:
    """Full outer join with the month spine; months without data get zero."""
    return df.join(month_spine(df.sparkSession, first, last, name), name, "full").fillna(0, subset=list(values))


def regular_monthly(df: DataFrame, series: str, month: str, value: str, first: str | None = None,
                    last: str | None = None) -> DataFrame:
    """Gap-free monthly series, one row per series and month, zero where nothing was recorded.

    Every series runs from its own first to its own last month; bounds can only extend it. The input has one row per series and month, so a series' months fit in one map whatever its history.
    """
    lo = F.least(F.lit(first).cast("date"), F.min(month))
    hi = F.greatest(F.lit(last).cast("date"), F.max(month))
    known = (df.where(F.col(month).isNotNull()).groupBy(series)
             .agg(F.map_from_entries(F.collect_list(F.struct(month, value))).alias("_known"),
                  F.sequence(lo, hi, F.expr("INTERVAL 1 MONTH")).alias("_months")))
    return (known.select(series, "_known", F.explode("_months").alias(month))
            .select(series, month, F.coalesce(F.try_element_at("_known", F.col(month)), F.lit(0.0)).alias(value)))
