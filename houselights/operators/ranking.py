"""Ordered results: top-k, positions over a whole table, exact quantiles."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from houselights.session import materialise

#: Hashes of an exact split, and what one round reads of them.
_HASH_BITS, _DIGIT_BITS = 60, 12


def top_k(df: DataFrame, k: int, by: str, tie_break: Sequence[str], descending: bool = True) -> DataFrame:
    """The k first rows. Sort and limit run as one bounded per-task top-k; the tie break makes it repeatable."""
    return df.orderBy(F.col(by).desc() if descending else F.col(by).asc(), *tie_break).limit(k)


def repeatable_sample(df: DataFrame, k: int, key: str) -> DataFrame:
    """k rows in an order that only depends on the key, so reruns agree."""
    return df.orderBy(F.md5(F.col(key).cast("string")), key).limit(k)


def in_first_part(key: Column, hex_bound: str = "cd") -> Column:
    """Repeatable split: true for the share of keys whose hash starts below the bound ('cd' is 80 %)."""
    return F.substring(F.md5(key.cast("string")), 1, 2) < hex_bound


def exact_split(df: DataFrame, key: Column, strata: Sequence[str], name: str, share: float = 0.8) -> DataFrame:
    """Repeatable split with exactly its share of every stratum (rounded half up): true for the rows whose keys hash lowest.

    The hash of the last row inside is found digit by digit: each of five rounds counts the next digit of the hashes that
    still begin like the threshold, so only counts are shuffled and no stratum is ordered in one place. Rows of one key stay
    together, on the inside where the threshold is theirs. Null strata are strata.
    """
    digits = _HASH_BITS // _DIGIT_BITS
    hashed = F.conv(F.substring(F.md5(key.cast("string")), 1, _HASH_BITS // 4), 16, 10).cast("bigint")
    rows = df.withColumns({"_hash": hashed, "_stratum": F.struct(*strata)})
    marked = materialise(rows.select("_stratum", "_hash"))
    state = marked.groupBy("_stratum").agg(F.floor(F.count("*") * share + 0.5).alias("target")).select(
        "_stratum", "target", F.lit(0).cast("bigint").alias("below"), F.lit(0).cast("bigint").alias("prefix"))
    upward = Window.partitionBy("_stratum").orderBy("digit")
    for level in range(1, digits + 1):
        shift = _HASH_BITS - level * _DIGIT_BITS
        digit = F.shiftright("_hash", shift).bitwiseAND(F.lit((1 << _DIGIT_BITS) - 1))
        counts = (marked.join(state, "_stratum").where(F.shiftright("_hash", shift + _DIGIT_BITS) == F.col("prefix"))
                  .groupBy("_stratum", "target", "below", "prefix", digit.alias("digit")).agg(F.count("*").alias("n")))
        reached = counts.withColumn("reached", F.col("below") + F.sum("n").over(upward)).where("reached >= target")
        state = reached.groupBy("_stratum", "target").agg(F.min_by(F.struct(
            (F.col("reached") - F.col("n")).alias("below"), (F.col("prefix") * (1 << _DIGIT_BITS) + F.col("digit")).alias("prefix")),
            F.col("digit")).alias("next")).select("_stratum", "target", "next.*")
    bounds = state.select("_stratum", F.when(F.col("target") > 0, F.col("prefix")).otherwise(-1).alias("_bound"))
    return rows.join(bounds, "_stratum").withColumn(name, F.col("_hash") <= F.col("_bound")).drop("_hash", "_stratum", "_bound")


def calendar_ordinal(df: DataFrame, ts: str, name: str) -> DataFrame:
    """Position (from 1) of distinct timestamps in time order.

    Numbers are assigned within each month and shifted by the count of earlier months: only the month table,
    which the calendar bounds, is ordered in one place.
    """
    month = F.trunc(ts, "MM")
    times = df.select(ts).where(month.isNotNull()).distinct().withColumn("_month", month)
    months = times.groupBy("_month").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_month").rowsBetween(Window.unboundedPreceding, -1)
    offsets = months.select("_month", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = F.row_number().over(Window.partitionBy("_month").orderBy(ts))
    return (times.withColumn("_pos", within).join(offsets, "_month")
            .select(ts, (F.col("_pos") + F.col("_offset")).cast("bigint").alias(name)))


def skip_first(df: DataFrame, n: int, by: str) -> DataFrame:
    """All but the n rows with the smallest keys. For calendar-sized tables (one row per month or day)."""
    return (df.withColumn("_pos", F.row_number().over(Window.orderBy(by)))
            .where(F.col("_pos") > n).drop("_pos"))


def global_row_number(df: DataFrame, by: str, unique: str, name: str, total: str) -> DataFrame:
    """Exact position of every row by (`by`, `unique`) and the number of rows, without ordering the table in one task.

    Rows are range-partitioned by both columns, so a frequent value is cut by the unique one, and sorted where they lie.
    They are written out once with their place in the partition; the counts of the partitions before it, one row each,
    make the place a position. Select the columns that are needed first: all are written.
    """
    placed = materialise(df.where(F.col(by).isNotNull()).repartitionByRange(by, unique).sortWithinPartitions(by, unique)
                         .withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    in_order = Window.orderBy("_part")
    before = F.sum("_n").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    everything = F.sum("_n").over(in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    offsets = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_before"), everything.alias(total))
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    # One row for each partition is broadcast.
    return (placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
            .withColumn(name, place + F.col("_before") + 1).drop("_at", "_part", "_before"))


def global_ntile(df: DataFrame, tiles: int, by: str, unique: str, name: str) -> DataFrame:
    """Equal-sized groups by rank over the whole table; earlier groups take the remainder, as NTILE does."""
    ranked = global_row_number(df, by, unique, "_rn", "_total")
    small, extra = F.expr(f"_total div {tiles}"), F.col("_total") % tiles
    in_large = extra * (small + 1)
    tile = (F.when(F.col("_rn") <= in_large, F.ceil(F.col("_rn") / (small + 1)))
            .otherwise(extra + F.ceil((F.col("_rn") - in_large) / F.greatest(small, F.lit(1)))))
    return ranked.withColumn(name, tile.cast("int")).drop("_rn", "_total")


def _quantile(column: str, p: float) -> Column:
    """Aggregate over numbered rows: the two order statistics around a probability, interpolated linearly."""
    position = (F.col("_total") - 1) * p + 1
    lower = F.max(F.when(F.col("_rn") == F.floor(position), F.col(column)))
    upper = F.max(F.when(F.col("_rn") == F.ceil(position), F.col(column)))
    return lower + (upper - lower) * F.max(position - F.floor(position))


def five_numbers(df: DataFrame, columns: Sequence[str], unique: str) -> DataFrame:
    """Minimum, quartiles, mean and maximum of each column, exact at any size: one row per column.

    `unique` is any well-spread number per row; it only cuts frequent values.
    """
    def one(column: str) -> DataFrame:
        rows = df.select(F.col(column).cast("double").alias("value"), F.col(unique).alias("unique"))
        return global_row_number(rows, "value", "unique", "_rn", "_total").agg(
            F.lit(column).alias("column"), F.min("value").alias("min_value"), _quantile("value", 0.25).alias("first_quartile"),
            _quantile("value", 0.5).alias("median"), F.avg("value").alias("mean"),
            _quantile("value", 0.75).alias("third_quartile"), F.max("value").alias("max_value"))

    return functools.reduce(DataFrame.union, map(one, columns))


def binned_density(df: DataFrame, groups: Sequence[str], value: str, low: float, high: float,
                   bins: int) -> DataFrame:
    """Histogram density of a measure per group: count over (group size x bin width)."""
    width = (high - low) / bins
    counts = (df.where(F.col(value).isNotNull())
              .withColumn("bin", F.width_bucket(F.col(value), F.lit(float(low)), F.lit(float(high)), F.lit(bins)))
              .groupBy(*groups, "bin").agg(F.count("*").alias("n")))
    total = F.sum("n").over(Window.partitionBy(*groups))
    return counts.withColumn("density", F.col("n") / (total * F.lit(width)))
