"""Weekday and price-zone reports over seat-level tickets.

Every report drops the Tuesday extras; `days` restricts to the regular performance days instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from houselights.functions import columns as c
from houselights.operators import bitmaps, reshape

SERIES_DAYS = ("Thursday", "Friday", "Saturday")
MAJOR_BANDS = ("A", "B", "C", "D")


def _performed(tickets: DataFrame, days: Sequence[str] | None) -> DataFrame:
    """Without Tuesdays, or only the named days."""
    perf_dt = F.col("perf_dt")
    return tickets.where(c.on_weekday(perf_dt, days) if days else ~c.on_weekday(perf_dt, ["Tuesday"]))


def normalise(tickets: DataFrame, days: Sequence[str] | None = None) -> DataFrame:
    """Seats with price zone, weekday, five-way price type and attendance flag."""
    return _performed(tickets, days).select(
        "perf_dt", "paid_amt", "summary_cust_id",
        c.price_zone(F.col("zone_desc")).alias("price_zone"),
        c.weekday(F.col("perf_dt")).alias("day_of_week"),
        c.price_type(F.col("price_type_group")).alias("price_type_group"),
        c.attended_flag(F.col("attended")).alias("attended"))


def sold(tickets: DataFrame, days: Sequence[str] | None = None, types: Sequence[str] = c.SOLD_TYPES) -> DataFrame:
    """Sold seats, or those of some raw price types. The filter is on the stored column, so it reaches the scan."""
    return normalise(tickets.where(F.col("price_type_group").isin(*types)), days)


def unsold(tickets: DataFrame, days: Sequence[str] | None = None) -> DataFrame:
    return normalise(tickets.where(~F.col("price_type_group").isin(*c.SOLD_TYPES)), days)


def paid_seats(tickets: DataFrame) -> DataFrame:
    return sold(tickets, types=[kind for kind in c.SOLD_TYPES if kind != c.RAW_COMP])


def giving_bands(donations: DataFrame) -> DataFrame:
    """Band A to H per customer on the total given."""
    return (donations.groupBy("summary_cust_id").agg(F.sum("gift_plus_pledge").alias("total"))
            .select("summary_cust_id", c.giving_band_8(F.col("total")).alias("donor_group")))


# --- by weekday ----------------------------------------------------------------------------------------------


def revenue(tickets: DataFrame) -> DataFrame:
    return sold(tickets).groupBy("day_of_week").agg(F.sum("paid_amt").alias("rev"))


def sold_and_attended(tickets: DataFrame) -> DataFrame:
    counts = paid_seats(tickets).groupBy("day_of_week").agg(
        F.count("*").alias("tix_sold"), F.sum("attended").alias("attended"))
    return reshape.unpivot(counts, ["day_of_week"], ["tix_sold", "attended"], "category", "count")


def comps(tickets: DataFrame) -> DataFrame:
    return (sold(tickets, types=[c.RAW_COMP])
            .groupBy("day_of_week").agg(F.count("*").alias("count")))


def unsold_seats(tickets: DataFrame) -> DataFrame:
    return unsold(tickets).groupBy("day_of_week").agg(F.count("*").alias("count"))


def subscribers(tickets: DataFrame) -> DataFrame:
    return (sold(tickets, types=[c.RAW_SUBSCRIPTION, c.RAW_FLEX])
            .groupBy("day_of_week", "price_type_group")
            .agg(F.countDistinct("summary_cust_id").alias("subscribers"), F.sum("paid_amt").alias("rev")))


def _banded_audience(tickets: DataFrame, donations: DataFrame, *keys: str) -> DataFrame:
    """Distinct customers per key with their giving band.

    Seats collapse to one row per customer and key before the join, so a customer with very many seats costs no more
    than any other.
    """
    audience = sold(tickets).select(*keys, "summary_cust_id").distinct()
    return (audience.join(giving_bands(donations), "summary_cust_id", "left")
            .withColumn("donor_group", F.coalesce("donor_group", F.lit("H"))))


def donors(tickets: DataFrame, donations: DataFrame, bands: Sequence[str] | None = None) -> DataFrame:
    """Distinct customers per weekday and giving band (all bands unless some are named)."""
    audience = _banded_audience(tickets, donations, "day_of_week")
    if bands:
        audience = audience.where(F.col("donor_group").isin(*bands))
    return audience.groupBy("day_of_week", "donor_group").agg(F.count("summary_cust_id").alias("donors"))


def revenue_by_fiscal_year(tickets: DataFrame, first_fy: int | None = None, last_fy: int | None = None) -> DataFrame:
    fy = c.fiscal_year(F.col("perf_dt"), first_fy, last_fy)
    return sold(tickets).groupBy(fy.alias("fy"), "day_of_week").agg(F.sum("paid_amt").alias("rev"))


def subscriber_tenure(tickets: DataFrame, this_fy: int, years: int = 4) -> DataFrame:
    """Subscribers of this fiscal year by weekday and number of the last `years` years they held that weekday."""
    held = (sold(tickets, types=[c.RAW_SUBSCRIPTION])
            .select("day_of_week", "summary_cust_id", c.fiscal_year(F.col("perf_dt")).alias("fy"))
            .where(F.col("fy").between(this_fy - years + 1, this_fy)))
    per_customer = (held.groupBy("day_of_week", "summary_cust_id")
                    .agg(F.countDistinct("fy").alias("held"), F.max("fy").alias("latest"))
                    .where(F.col("latest") == this_fy))
    label = F.when(F.col("held") == years, f"{years}+").otherwise(F.col("held").cast("string"))
    return (per_customer.groupBy("day_of_week", label.alias("length_of_tenure"))
            .agg(F.count("*").alias("subscribers")))


# --- by weekday and price zone -------------------------------------------------------------------------------

_ZONE = ("day_of_week", "price_zone")


def zone_revenue(tickets: DataFrame) -> DataFrame:
    return sold(tickets).groupBy(*_ZONE).agg(F.sum("paid_amt").alias("rev"))


def zone_sold(tickets: DataFrame) -> DataFrame:
    return paid_seats(tickets).groupBy(*_ZONE).agg(F.count("*").alias("tix_sold"))


def zone_percent_sold(tickets: DataFrame) -> DataFrame:
    """Paid seats over paid plus unsold seats; zones must have both (inner semantics). One pass over the seats."""
    kind = F.col("price_type_group")
    counts = normalise(tickets).groupBy(*_ZONE).agg(
        F.count_if(~kind.isin("Unsold", "Comp")).alias("tix_sold"), F.count_if(kind == "Unsold").alias("unsold"))
    return (counts.where((F.col("tix_sold") > 0) & (F.col("unsold") > 0))
            .select(*_ZONE, c.ratio(F.col("tix_sold"), F.col("tix_sold") + F.col("unsold")).alias("percentage_sold")))


def zone_average_price(tickets: DataFrame, singles_only: bool = False) -> DataFrame:
    seats = sold(tickets, types=[c.RAW_SINGLE, c.RAW_DISCOUNT]) if singles_only else paid_seats(tickets)
    return seats.groupBy(*_ZONE).agg(c.ratio(F.sum("paid_amt"), F.count("*")).alias("avg_price"))


def zone_comps(tickets: DataFrame) -> DataFrame:
    counts = (sold(tickets, types=[c.RAW_COMP]).groupBy(*_ZONE)
              .agg(F.count("*").alias("comps"), F.sum("attended").alias("attendance")))
    return reshape.unpivot(counts, _ZONE, ["comps", "attendance"], "category", "count")


def zone_attendance_rate(tickets: DataFrame) -> DataFrame:
    return paid_seats(tickets).groupBy(*_ZONE).agg(c.ratio(F.sum("attended"), F.count("*")).alias("attendance"))


def zone_subscribers(tickets: DataFrame, price_type: str) -> DataFrame:
    return (sold(tickets, types=[price_type])
            .groupBy(*_ZONE, "price_type_group")
            .agg(F.countDistinct("summary_cust_id").alias("subscribers"), F.sum("paid_amt").alias("rev")))


def customer_roll_up(tickets: DataFrame) -> DataFrame:
    """The customers of every day, zone and price type as mergeable sets: store it, and any range of days is counted
    without the seats. A new day's roll-up is appended to the stored ones."""
    return bitmaps.roll_up(sold(tickets).withColumn("day", F.to_date("perf_dt")), "summary_cust_id",
                           "day", *_ZONE, "price_type_group")


def zone_uniques(rolled: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """Unique customers per weekday, zone and price type over the days from first to last, both included."""
    for bound, inside in ((first, F.col("day") >= F.lit(first).cast("date")), (last, F.col("day") <= F.lit(last).cast("date"))):
        rolled = rolled.where(inside) if bound else rolled
    return bitmaps.unique_counts(rolled, *_ZONE, "price_type_group", name="customers")


def zone_major_donors(tickets: DataFrame, donations: DataFrame) -> DataFrame:
    return (_banded_audience(tickets, donations, *_ZONE).where(F.col("donor_group").isin(*MAJOR_BANDS))
            .groupBy(*_ZONE).agg(F.count("summary_cust_id").alias("donors")))


def percent_of_potential_revenue(tickets: DataFrame, list_prices: DataFrame) -> DataFrame:
    """Earned revenue over seats times list price. Days without a list price have no potential (NULL)."""
    sellable = F.col("price_type_group") != "Unsold"
    zones = normalise(tickets).groupBy(*_ZONE).agg(
        F.count("*").alias("available"), F.count_if(sellable).alias("tickets"),
        F.sum(F.when(sellable, F.col("paid_amt"))).alias("earned"))
    potential = F.col("available") * F.col("standard_price")
    return (zones.where(F.col("tickets") > 0).join(F.broadcast(list_prices), list(_ZONE), "left")
            .select(*_ZONE, c.ratio(F.col("earned"), potential).alias("percentage")))


def sell_type_mix(tickets: DataFrame, list_prices: DataFrame, singles_only: bool = False) -> DataFrame:
    """Share of Comp, Discount and Full within each weekday and zone. The 18 list prices are a fixed table."""
    seats = sold(tickets, types=[c.RAW_SINGLE, c.RAW_DISCOUNT, c.RAW_COMP]) if singles_only else sold(tickets)
    typed = (seats.join(F.broadcast(list_prices), list(_ZONE), "left")
             .groupBy(*_ZONE, c.sell_type(F.col("price_type_group"), F.col("paid_amt"), F.col("standard_price"))
                      .alias("sell_type"))
             .agg(F.count("*").alias("tickets_sold")))
    return (reshape.share_of_total(typed, "tickets_sold", _ZONE, "percent_sold")
            .select(*_ZONE, "sell_type", "percent_sold"))


# --- monthly -------------------------------------------------------------------------------------------------


def monthly(tickets: DataFrame) -> DataFrame:
    """Revenue per performance and paid seats by month and weekday (long form)."""
    # First by performance: a plain count of those rows then stands for a distinct count beside the sums.
    per_performance = paid_seats(tickets).groupBy("perf_dt", "day_of_week").agg(
        F.sum("paid_amt").alias("paid"), F.count("*").alias("seats"))
    return (per_performance.groupBy(c.month_start(F.col("perf_dt")).alias("month"), "day_of_week")
            .agg(c.ratio(F.sum("paid"), F.count("perf_dt")).alias("rev_per_perf"),
                 F.sum("seats").cast("double").alias("tix_sold")))


def monthly_wide(tickets: DataFrame, measure: str, first: str, last: str,
                 days: Sequence[str] = SERIES_DAYS) -> DataFrame:
    """One column per weekday over the month spine, zero where there was no performance."""
    names = {day: day.lower() for day in days}
    wide = reshape.pivot_fixed(monthly(tickets), ["month"], "day_of_week", names, F.first(measure))
    return reshape.fill_months(wide, first, last, list(names.values()))


def monthly_series(tickets: DataFrame, measure: str, first: str, last: str,
                   days: Sequence[str] = SERIES_DAYS) -> DataFrame:
    """The same in long form: one regular series per weekday."""
    long = (monthly(tickets).where(F.col("day_of_week").isin(*days))
            .select(F.col("day_of_week").alias("series_id"), "month", F.col(measure).alias("y")))
    return reshape.regular_monthly(long, "series_id", "month", "y", first, last)


def ages_by_weekday(tickets: DataFrame, birth_years: DataFrame, as_of_year: int,
                    days: Sequence[str] = SERIES_DAYS) -> DataFrame:
    """Distinct paying customers by weekday and age decade, and their share of the weekday."""
    audience = (tickets.where((F.col("paid_amt") != 0) & (F.col("summary_cust_id") != 0))
                .where(c.on_weekday(F.col("perf_dt"), days))
                .select("summary_cust_id", c.weekday(F.col("perf_dt")).alias("dow")).distinct())
    ages = (birth_years.where(F.col("key_value") != 0)
            .select(F.col("customer_no").alias("summary_cust_id"),
                    c.age_decade(F.lit(as_of_year) - F.col("key_value")).alias("age_grp")))
    counts = audience.join(ages, "summary_cust_id").groupBy("dow", "age_grp").agg(F.count("*").alias("count"))
    return reshape.share_of_total(counts, "count", ["dow"], "percent")


def day_order(df: DataFrame, column: str = "day_of_week", days: Sequence[str] = SERIES_DAYS) -> DataFrame:
    """Sort by the given weekday order, other days last."""
    position = F.array_position(F.array(*[F.lit(d) for d in days]), F.col(column))
    return df.orderBy(F.when(position == 0, len(days) + 1).otherwise(position), column)
