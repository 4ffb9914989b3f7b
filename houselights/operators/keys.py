"""Key sets, membership tests and scalar-valued filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_set(df: DataFrame, *keys: str) -> DataFrame:
    """Distinct non-null keys. Duplicates collapse before the shuffle, so a hot key costs one row per task."""
    return df.select(*keys).dropna().distinct()


def flag_members(df: DataFrame, keys: DataFrame, on: str, name: str) -> DataFrame:
    """Add a boolean column telling whether the key is in `keys` (distinct)."""
    marked = keys.select(on, F.lit(True).alias(name))
    return df.join(marked, on, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def keep_members(df: DataFrame, keys: DataFrame, on: str | Sequence[str]) -> DataFrame:
    return df.join(keys, on, "left_semi")


def drop_members(df: DataFrame, keys: DataFrame, on: str | Sequence[str]) -> DataFrame:
    return df.join(keys, on, "left_anti")


def counts_within(df: DataFrame, key: str, most: int, name: str = "n") -> DataFrame:
    """Keys that own at most `most` rows, with that number."""
    return df.groupBy(key).agg(F.count("*").alias(name)).where(F.col(name) <= most)


def keys_within_count(df: DataFrame, key: str, most: int) -> DataFrame:
    """Keys that own at most `most` rows."""
    return counts_within(df, key, most).select(key)


def scalar(df: DataFrame, aggregate: Column) -> Column:
    """One aggregate of a table as an uncorrelated scalar subquery."""
    return df.agg(aggregate.alias("v")).scalar()


def latest(df: DataFrame, column: str, this: int | None) -> Column:
    """The given year, or the latest one present when none is given.

    Pass the year where it is known: a literal prunes partitions, the subquery scans one more column.
    """
    return F.lit(this) if this is not None else scalar(df, F.max(column))


def keep_at_max(df: DataFrame, column: str) -> DataFrame:
    """Rows that hold the column's maximum, ties included."""
    return df.where(F.col(column) == scalar(df, F.max(column)))


def natural_left_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join on every column name the two sides share."""
    shared = [name for name in left.columns if name in right.columns]
    if not shared:
        raise ValueError("no shared columns to join on")
    return left.join(right, shared, "left")
