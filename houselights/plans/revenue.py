"""Revenue mix by fiscal year and revenue series per performance and month."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from houselights.functions import columns as c
from houselights.operators import keys, reshape

BANDS = {"A": "grp_a", "B": "grp_b", "C": "grp_c", "D": "grp_d"}


def season_labels(first_fy: int, last_fy: int) -> list[str]:
    return [f"PS {(fy - 1) % 100:02d}-{fy % 100:02d}" for fy in range(first_fy, last_fy + 1)]


def _campaigns(donations: DataFrame, seasons: Sequence[str]) -> DataFrame:
    fy = c.campaign_season(F.col("campaign"))
    return donations.where(fy.isin(*seasons)).select(fy.alias("fy"), "summary_cust_id", "gift_plus_pledge")


def _paid(tickets: DataFrame) -> DataFrame:
    return tickets.where((F.col("summary_cust_id") > 0) & (F.col("paid_amt") > 0)).select(
        c.season_label(c.fiscal_year(F.col("perf_dt"))).alias("fy"), "paid_amt", "price_type_group")


def mix_aggregate(donations: DataFrame, tickets: DataFrame, seasons: Sequence[str]) -> DataFrame:
    """Contributed against earned revenue per season, as shares."""
    contributed = _campaigns(donations, seasons).groupBy("fy").agg(F.sum("gift_plus_pledge").alias("contributed_rev"))
    earned = _paid(tickets).groupBy("fy").agg(F.sum("paid_amt").alias("earned_rev"))
    return reshape.row_shares(keys.natural_left_join(contributed, earned), ["contributed_rev", "earned_rev"])


def mix_split(donations: DataFrame, tickets: DataFrame, seasons: Sequence[str]) -> DataFrame:
    """Giving bands and ticket kinds per season, as shares."""
    per_donor = (_campaigns(donations, seasons).groupBy("fy", "summary_cust_id")
                 .agg(F.sum("gift_plus_pledge").alias("given"))
                 .withColumn("band", c.giving_band_4(F.col("given"), inclusive=True)))
    given = reshape.pivot_fixed(per_donor, ["fy"], "band", BANDS, F.sum("given"))
    kinds = _paid(tickets).withColumn("kind", c.single_or_subscription(F.col("price_type_group")))
    sold = reshape.pivot_fixed(kinds, ["fy"], "kind", {"Single": "single", "Subscription": "subscription"},
                               F.sum("paid_amt"))
    return reshape.row_shares(given.join(sold, "fy", "left"), [*BANDS.values(), "single", "subscription"])


def per_performance(tickets: DataFrame, as_of: str, cap: float | None = None) -> DataFrame:
    """Paid single and subscription revenue of performances that had both, before `as_of`; singles capped.

    One pass instead of two aggregates and a join.
    """
    raw = F.col("price_type_group")
    single = F.when(c.is_single(raw), F.col("paid_amt"))
    held = F.when(c.is_subscription(raw), F.col("paid_amt"))
    both = (tickets.where((F.col("perf_dt") < F.lit(as_of).cast("timestamp_ntz")) & (F.col("paid_amt") > 0))
            .groupBy("perf_dt").agg(F.sum(single).alias("total_rev_singles"), F.sum(held).alias("total_rev_subs"))
            .dropna())
    return both if cap is None else both.withColumn("total_rev_singles", c.cap(F.col("total_rev_singles"), cap))


def monthly_series(performances: DataFrame, first: str, last: str) -> DataFrame:
    """Mean revenue per performance by month as regular series: singles, subs and both combined."""
    monthly = (performances.groupBy(c.month_start(F.col("perf_dt")).alias("month"))
               .agg(F.avg("total_rev_singles").alias("singles"), F.avg("total_rev_subs").alias("subs"))
               .withColumn("combined", F.col("singles") + F.col("subs")))
    long = reshape.unpivot(monthly, ["month"], ["singles", "subs", "combined"], "series_id", "y")
    return reshape.regular_monthly(long, "series_id", "month", "y", first, last)
