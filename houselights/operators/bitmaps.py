"""Exact unique counts from stored sets: one set per key and block of ids, merged by OR for any coarser key or range.

Ids fall into blocks of 32,768. A stored set is a bitmap of 4 KB where it holds more than SPARSE ids of a block, else the
list of their places, so few ids of a wide range take no more room than the ids themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Places of two bytes that fill as much room as a bitmap.
SPARSE = 2048


def roll_up(df: DataFrame, who: str, *keys: str) -> DataFrame:
    """The ids of each key as (keys, block, spots, bits); NULL ids are left out.

    Repeated ids go in the first, map-side combined step, so a set never gathers more than the places of its block.
    """
    places = (df.where(F.col(who).isNotNull())
              .select(*keys, F.bitmap_bucket_number(who).alias("block"), F.bitmap_bit_position(who).alias("spot")).distinct())
    sets = places.groupBy(*keys, "block").agg(
        F.collect_list(F.col("spot").cast("smallint")).alias("spots"), F.bitmap_construct_agg("spot").alias("bits"))
    sparse = F.size("spots") <= SPARSE
    return sets.withColumns({"spots": F.when(sparse, F.sort_array("spots")), "bits": F.when(~sparse, F.col("bits"))})


def merged(rolled: DataFrame, *keys: str) -> DataFrame:
    """One bitmap per key and block over all sets of a roll-up: (keys, block, bits)."""
    few = (rolled.where(F.col("spots").isNotNull()).select(*keys, "block", F.explode("spots").alias("spot")).distinct()
           .groupBy(*keys, "block").agg(F.bitmap_construct_agg(F.col("spot").cast("bigint")).alias("bits")))
    many = rolled.where(F.col("bits").isNotNull()).select(*keys, "block", "bits")
    return few.unionByName(many).groupBy(*keys, "block").agg(F.bitmap_or_agg("bits").alias("bits"))


def unique_counts(rolled: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    """Distinct ids per key, read from the roll-up alone."""
    return merged(rolled, *keys).groupBy(*keys).agg(F.sum(F.bitmap_count("bits")).alias(name))
