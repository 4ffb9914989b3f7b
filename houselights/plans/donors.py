"""Donor reports: retention, legacy list, major donors among subscribers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from houselights.functions import columns as c


def yearly_bands(donations: DataFrame) -> DataFrame:
    """Giving band per donor and fiscal year."""
    return (donations.groupBy("summary_cust_id", F.col("cont_fy").alias("fy"))
            .agg(F.sum("gift_plus_pledge").alias("given"))
            .select("summary_cust_id", "fy", c.giving_band_4(F.col("given")).alias("band")))


def retention(donations: DataFrame) -> DataFrame:
    """Share of each year's donors, by band, who were lost, moved or stayed in the next recorded year.

    Years are numbered by the years present, so the next year of a donor is looked up by position. The donor window
    holds at most one row per fiscal year.
    """
    banded = yearly_bands(donations).where(F.col("summary_cust_id").isNotNull() & F.col("fy").isNotNull())
    years = banded.select("fy").distinct()
    ordinals = years.select("fy", F.row_number().over(Window.orderBy("fy")).alias("ord"),
                            F.lead("fy").over(Window.orderBy("fy")).alias("next_fy"))
    by_donor = Window.partitionBy("summary_cust_id").orderBy("ord")
    followed = (banded.join(ordinals, "fy")
                .withColumns({"next_ord": F.lead("ord").over(by_donor), "next_band": F.lead("band").over(by_donor)})
                .where(F.col("next_fy").isNotNull()))
    current = F.when(F.col("next_ord") == F.col("ord") + 1, F.col("next_band"))
    scored = followed.select(F.col("band").alias("grp"), F.col("next_fy").alias("fy"),
                             c.retention(F.col("band"), current).alias("score"))
    part = {name: F.avg(F.when(F.col("score") == name, 1.0).otherwise(0.0)).alias(name)
            for name in ("lost", "downgrade", "maintain", "upgrade")}
    return (scored.groupBy("grp", "fy").agg(*part.values())
            .withColumn("total_retention", F.col("downgrade") + F.col("maintain") + F.col("upgrade")))


def legacy_donors(donations: DataFrame, birth_years: DataFrame, customers: DataFrame, this_fy: int,
                  as_of_year: int) -> DataFrame:
    """Giving history with age, and segment and subscription from a segmented customer table.

    The longest window reaches back ten years before this one.
    """
    fy, gift = F.col("cont_fy"), F.col("gift_plus_pledge")

    def given(first: int, last: int):
        return F.coalesce(F.sum(F.when(fy.between(first, last), gift)), F.lit(0.0))

    history = (donations.where(fy <= this_fy).groupBy("summary_cust_id")
               .agg(given(this_fy, this_fy).alias("amt_cy"), given(this_fy - 1, this_fy - 1).alias("amt_py"),
                    given(this_fy - 4, this_fy).alias("amt_last5yrs"),
                    given(this_fy - 10, this_fy).alias("amt_last10yrs"),
                    F.max(fy).alias("most_recent_cont_yr")))
    ages = birth_years.select(F.col("customer_no").alias("summary_cust_id"), F.col("key_value").alias("birth_yr"),
                              c.age(F.col("key_value"), as_of_year).alias("age"))
    known = customers.select("summary_cust_id", "segment", F.when(F.col("subscriber") == 1, 1).alias("subscriber"))
    return history.join(ages, "summary_cust_id", "left").join(known, "summary_cust_id", "left")


def major_donor_subscribers(donations: DataFrame, tickets: DataFrame, customers: DataFrame, fy: int, as_of: str,
                            least: float = 2500.0, days: Sequence[str] = ("Friday", "Tuesday")) -> DataFrame:
    """Donors of at least `least` in a fiscal year who subscribe on the given weekdays, with attendance and name."""
    major = (donations.where(F.col("cont_fy") == fy).groupBy("summary_cust_id")
             .agg(F.sum("gift_plus_pledge").alias("total_gift")).where(F.col("total_gift") >= least))
    held = (tickets.where((F.col("perf_dt") < F.lit(as_of).cast("timestamp_ntz"))
                          & (F.col("price_type_group") == c.RAW_SUBSCRIPTION)
                          & F.col("summary_cust_id").isNotNull()
                          & c.on_weekday(F.col("perf_dt"), days))
            .groupBy("summary_cust_id")
            .agg(F.count("*").alias("tix"), F.sum(c.attended_flag(F.col("attended"))).alias("attendance"),
                 F.sum("paid_amt").alias("total_paid_amt"))
            .withColumn("attendance_rate", c.ratio(F.col("attendance"), F.col("tix"))))
    named = major.join(held, "summary_cust_id")
    return (named.join(customers, F.col("summary_cust_id") == F.col("customer_no"), "left").drop("customer_no"))


def bands_by_rule(donations: DataFrame) -> DataFrame:
    """Each customer's total under the three banding rules."""
    total = F.col("total_gift")
    return (donations.groupBy("summary_cust_id").agg(F.sum("gift_plus_pledge").alias("total_gift"))
            .select("summary_cust_id", c.giving_band_8(total).alias("band_8"),
                    c.giving_band_4(total).alias("band_4_below"),
                    c.giving_band_4(total, inclusive=True).alias("band_4_up_to")))
