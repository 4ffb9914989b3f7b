"""Item sets from the vertical side: one bitmap of basket numbers per item, supports by AND and bit count.

A support of 0 keeps every set that occurs. The work follows the items and their bitmaps, one pass over the baskets in all;
a level of larger sets reads only the bitmaps of the level before. Candidates are pairs of item sets with a common head, so
their number follows the programmes on offer, not the customers.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from houselights.session import materialise


def item_bitmaps(basket_rows: DataFrame) -> tuple[DataFrame, int]:
    """(items, block, bits) of single items, and the number of baskets. NULL items are none; repeats count once.

    Basket numbers are gapless within a stored partition, so all blocks but the last of each are full.
    """
    numbered = materialise(basket_rows.select("items", F.monotonically_increasing_id().alias("number")))
    bits = (numbered.select("number", F.explode("items").alias("item")).where(F.col("item").isNotNull())
            .groupBy(F.array("item").alias("items"), F.bitmap_bucket_number("number").alias("block"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits")))
    return materialise(bits), numbered.count()


def _counts(bits: DataFrame, total: int, support: float) -> DataFrame:
    found = bits.groupBy("items").agg(F.sum(F.bitmap_count("bits")).alias("freq"))
    return materialise(found.withColumn("support", F.col("freq") / F.lit(total)).where(F.col("support") >= support))


def _larger(bits: DataFrame, counts: DataFrame, size: int) -> DataFrame:
    """Bitmaps of the sets of `size` items that two frequent sets with the same first size - 2 items make."""
    def side(name: str) -> DataFrame:
        return counts.select(F.slice("items", 1, size - 2).alias("head"), F.element_at("items", -1).alias(name))

    grown = side("a").join(side("b"), "head").where(F.col("a") < F.col("b")).select(
        F.concat("head", F.array("a", "b")).alias("grown"),
        F.explode(F.array(F.concat("head", F.array("a")), F.concat("head", F.array("b")))).alias("items"))
    both = grown.join(bits, "items").groupBy(F.col("grown").alias("items"), "block").agg(
        F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("sides"))
    return materialise(both.where("sides = 2").drop("sides").where(F.bitmap_count("bits") > 0))


def itemsets(basket_rows: DataFrame, support: float = 0.0, least_items: int = 1, most_items: int = 3) -> DataFrame:
    """All sets of `least_items` to `most_items` items with freq and support, in no order; items are sorted."""
    if not 1 <= least_items <= most_items:
        raise ValueError("least_items must lie between 1 and most_items")
    bits, total = item_bitmaps(basket_rows)
    counts = _counts(bits, total, support)
    levels = [counts]
    for size in range(2, most_items + 1):
        bits = _larger(bits, counts, size)
        counts = _counts(bits, total, support)
        levels.append(counts)
    return functools.reduce(DataFrame.unionByName, levels[least_items - 1:])


def rules(basket_rows: DataFrame, support: float = 0.0, confidence: float = 0.5, most_items: int = 3) -> DataFrame:
    """If-then rules with one item on the right, bounded by their confidence alone where support is 0."""
    sets = materialise(itemsets(basket_rows, support, 1, most_items))

    def known(name: str) -> DataFrame:
        return sets.select(F.col("items").alias(name), F.col("freq").alias(f"{name}_freq"), F.col("support").alias(f"{name}_support"))

    parts = (sets.where(F.size("items") > 1).select("items", "freq", "support", F.explode("items").alias("item"))
             .select("freq", "support", F.array_remove("items", F.col("item")).alias("left"), F.array("item").alias("right")))
    share: Column = F.col("freq") / F.col("left_freq")
    return (parts.join(known("left"), "left").where(share >= confidence).join(known("right"), "right")
            .select(F.concat_ws("|", "left").alias("antecedent"), F.concat_ws("|", "right").alias("consequent"),
                    share.alias("confidence"), (share / F.col("right_support")).alias("lift"), "support"))
