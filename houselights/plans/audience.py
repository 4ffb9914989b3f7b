"""Customer analytics: key sets, segments, concert audiences, tenure and flow.

Most reports start from `facts`, one pass over the tickets that reduces them to one row per customer. Everything a
report needs is collected in that pass with conditional aggregates, so the seat table is shuffled once, already
combined map-side; joins then run between customer-level tables.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from houselights.functions import columns as c
from houselights.operators import keys, ranking, reshape
from houselights.session import materialise

SEAT_CAP = 500
MIN_PAID = 5.0
LOWEST_FREQUENCY = 2.1  # Fixed value: the lower frequency bound when mean minus deviation is not positive.


@dataclass(frozen=True)
class AudienceRules:
    """Which tickets and customers count."""

    this_fy: int
    seat_cap: int = SEAT_CAP
    min_paid: float = MIN_PAID


def series_seasons(this_fy: int, series: str, years: int = 2) -> list[str]:
    """Season labels of a series for the last `years` fiscal years, e.g. 'PS 17-18 Pops', 'PS 18-19 Pops'."""
    return [f"PS {(fy - 1) % 100:02d}-{fy % 100:02d} {series}" for fy in range(this_fy - years + 1, this_fy + 1)]


def _any(condition: Column) -> Column:
    return F.coalesce(F.max(F.when(condition, 1)), F.lit(0))


def facts(tickets: DataFrame, rules: AudienceRules, seasons: Sequence[str] | None = None,
          concert_days: Sequence[str] | None = None, valued_from: int | None = None) -> DataFrame:
    """One row per customer within the seat cap that has at least one counted ticket.

    Counted: a known customer and more than `min_paid` paid, up to this fiscal year. The cap looks at all of a
    customer's seats. `seasons` limits frequency and spending to those seasons, `valued_from` to fiscal years from then on.
    `concert_days` adds the days of this
    year the customer attended (any of the named ones, or all for an empty list).
    """
    fy_now = rules.this_fy
    fy = c.fiscal_year(F.col("perf_dt"))
    seats = (tickets.where((F.col("summary_cust_id") > 0) & (fy <= fy_now))
             .select("summary_cust_id", "perf_dt", "paid_amt", "price_type_group", "season_desc", fy.alias("fy")))
    counted = F.col("paid_amt") > rules.min_paid
    valued = counted & F.col("season_desc").isin(*seasons) if seasons else counted
    if valued_from is not None:
        valued = valued & (F.col("fy") >= valued_from)
    now = counted & (F.col("fy") == fy_now)
    measures = [
        F.count("*").alias("seats"),
        F.count_if(counted).alias("counted"),
        F.count_if(valued).alias("freq"),
        F.sum(F.when(valued, F.col("paid_amt"))).alias("tot_paid_amt"),
        _any(counted & (F.col("fy") == fy_now - 1)).alias("last_year"),
        _any(counted & F.col("fy").isin(fy_now - 2, fy_now - 3)).alias("returned"),
        _any(now & c.is_subscription(F.col("price_type_group"))).alias("subscriber"),
        F.min(F.when(now, F.col("perf_dt"))).alias("first_this_year"),
    ]
    if concert_days is not None:
        day = F.to_date("perf_dt")
        here = now & (F.col("perf_dt") > day.cast("timestamp_ntz"))
        if concert_days:
            here = here & day.isin(*[F.lit(d).cast("date") for d in concert_days])
        measures.append(F.collect_set(F.when(here, day)).alias("concert_days"))
    grouped = seats.groupBy("summary_cust_id").agg(*measures)
    return (grouped.where((F.col("seats") <= rules.seat_cap) & (F.col("counted") > 0))
            .withColumn("avg_paid_amt", F.try_divide(F.col("tot_paid_amt"), F.col("freq"))))


def frequency_value(tickets: DataFrame, rules: AudienceRules, seasons: Sequence[str] | None = None) -> DataFrame:
    return (facts(tickets, rules, seasons).where(F.col("freq") > 0)
            .select("summary_cust_id", "freq", "avg_paid_amt", "tot_paid_amt"))


def thresholds(customers: DataFrame) -> Column:
    """Price and frequency thresholds of a customer table, as one struct-valued scalar subquery."""
    price, freq_mid = F.sum("tot_paid_amt") / F.sum("freq"), F.avg("freq")
    price_sd, freq_sd = F.stddev_samp("avg_paid_amt"), F.stddev_samp("freq")
    return keys.scalar(customers, F.struct(
        price.alias("price_mid"), (price + price_sd).alias("price_high"), freq_mid.alias("freq_mid"),
        (freq_mid + freq_sd).alias("freq_high"),
        F.when(freq_mid - freq_sd <= 0, LOWEST_FREQUENCY).otherwise(freq_mid - freq_sd).alias("freq_low")))


def with_segment(customers: DataFrame, name: str = "segment") -> DataFrame:
    """Segment every customer with a frequency; customers without one stay unknown.

    Thresholds and labels both read the customer table, so it is written out once instead of reading the seats twice.
    """
    customers = materialise(customers)
    valued = customers.where(F.col("freq") > 0)
    t = [F.col("_t")[part] for part in ("price_mid", "price_high", "freq_mid", "freq_high", "freq_low")]
    label = c.segment(F.col("avg_paid_amt"), F.col("freq"), *t)
    return (customers.withColumn("_t", thresholds(valued))
            .withColumn(name, F.when(F.col("freq") > 0, label)).drop("_t"))


def segments(tickets: DataFrame, rules: AudienceRules, seasons: Sequence[str] | None = None) -> DataFrame:
    return with_segment(frequency_value(tickets, rules, seasons))


def key_sets(tickets: DataFrame, rules: AudienceRules) -> DataFrame:
    """Customers to renew (this or last year), to win back (two or three years ago) and subscribers."""
    per_customer = facts(tickets, rules)
    renew = ((F.col("last_year") == 1) | F.col("first_this_year").isNotNull()).cast("int")
    flags = per_customer.select("summary_cust_id", renew.alias("renew"), F.col("returned").alias("return"),
                                "subscriber")
    return (reshape.unpivot(flags, ["summary_cust_id"], ["renew", "return", "subscriber"], "key_set", "member")
            .where(F.col("member") == 1).drop("member"))


def giving(donations: DataFrame, first_fy: int | None = None, last_fy: int | None = None) -> DataFrame:
    """Total given per customer in a window of fiscal years; open ends by default."""
    if first_fy is not None:
        donations = donations.where(F.col("cont_fy") >= first_fy)
    if last_fy is not None:
        donations = donations.where(F.col("cont_fy") <= last_fy)
    return donations.groupBy("summary_cust_id").agg(F.sum("gift_plus_pledge").alias("gift_plus_pledge"))


def concert_audience(tickets: DataFrame, donations: DataFrame, rules: AudienceRules,
                     seasons: Sequence[str] | None = None, dates: Sequence[str] = (),
                     gifts_from: int | None = None) -> DataFrame:
    """Attendees of this year's concerts, described as of each concert day.

    Segments rest on the named seasons, or else on this and the last fiscal year. `gifts_from` limits giving to fiscal
    years from then on. One job serves any number of dates (all of the fiscal year's when none are named). A customer renews when they
    came last year, or this year before the concert; an unknown segment reads '0'.
    """
    known = with_segment(facts(tickets, rules, seasons, list(dates), None if seasons else rules.this_fy - 1))
    attendees = known.select("*", F.explode("concert_days").alias("concert_date"))
    came_before = F.col("first_this_year") < F.col("concert_date").cast("timestamp_ntz")
    renew = F.when((F.col("last_year") == 1) | came_before, 1).otherwise(0)
    given = F.coalesce("gift_plus_pledge", F.lit(0.0))
    return (attendees.join(giving(donations, gifts_from), "summary_cust_id", "left")
            .select("concert_date", "summary_cust_id", renew.alias("renew"), F.col("returned").alias("return"),
                    "subscriber", given.alias("donor_5yr_history"),
                    F.coalesce("segment", F.lit("0")).alias("segment"),
                    c.classification(renew, F.col("returned")).alias("classification"),
                    F.concat(F.lit("Group "), c.giving_band_4(given)).alias("donor_group")))


def audience_counts(audience: DataFrame) -> DataFrame:
    """Attendees per concert by classification, type, segment and donor group, in one pass."""
    labelled = audience.select("concert_date", "classification",
                               F.when(F.col("subscriber") == 1, "subscriber").otherwise("single").alias("type"),
                               "segment", "donor_group")
    long = reshape.unpivot(labelled, ["concert_date"], ["classification", "type", "segment", "donor_group"],
                           "dimension", "level")
    return long.groupBy("concert_date", "dimension", "level").agg(F.count("*").alias("count"))


def one_day(tickets: DataFrame, date: str) -> DataFrame:
    """Tickets of one concert day: strictly after its midnight and strictly before the next."""
    day = F.lit(date).cast("date")
    return tickets.where((F.col("perf_dt") > day.cast("timestamp_ntz"))
                         & (F.col("perf_dt") < F.date_add(day, 1).cast("timestamp_ntz")))


def counted_seats(seats: DataFrame, rules: AudienceRules) -> DataFrame:
    """Seats of a known customer with more than the least payment."""
    return seats.where((F.col("summary_cust_id") > 0) & (F.col("paid_amt") > rules.min_paid))


def seat_finder(concert: DataFrame, all_tickets: DataFrame, customers: DataFrame, rules: AudienceRules) -> DataFrame:
    """Customer, name and seat for one concert. Seats are counted for that concert's customers only.

    Unsold seats share the customer 0: they go before the join, or one task would get them all.
    """
    rows = counted_seats(concert, rules)
    here = keys.key_set(rows, "summary_cust_id")
    held = all_tickets.where(F.col("summary_cust_id") > 0)
    within = keys.keys_within_count(keys.keep_members(held, here, "summary_cust_id"), "summary_cust_id", rules.seat_cap)
    names = customers.select(F.col("customer_no").alias("summary_cust_id"),
                             F.col("display_name").alias("summary_cust_name"))
    return (keys.keep_members(rows, within, "summary_cust_id").join(names, "summary_cust_id", "left")
            .select("summary_cust_id", "summary_cust_name",
                    c.seat_label(F.col("section"), F.col("row"), F.col("seat")).alias("seat")))


def concert_date_by_number(tickets: DataFrame, number: int) -> DataFrame:
    """Date of the n-th performance: a bounded top-n lookup, one row."""
    first_n = tickets.select("perf_dt").dropna().distinct().orderBy("perf_dt").limit(number)
    return first_n.agg(F.max("perf_dt").alias("perf_dt"))


def performance_numbers(tickets: DataFrame) -> DataFrame:
    return ranking.calendar_ordinal(tickets, "perf_dt", "concert_number")


def customer_flow(tickets: DataFrame, concert_number: int, excluded_ids: Sequence[int] = ()) -> DataFrame:
    """How many non-subscribers had been to how many performances by the n-th performance."""
    cutoff = concert_date_by_number(tickets, concert_number).scalar()
    seats = tickets.where(F.col("summary_cust_id") > 0)
    if excluded_ids:
        seats = seats.where(~F.col("summary_cust_id").isin(*excluded_ids))
    seen = F.when((F.col("perf_dt") <= cutoff) & (F.col("price_type_group") != c.RAW_COMP), F.col("perf_dt"))
    per_performance = (seats.groupBy("summary_cust_id", seen.alias("seen"))
                       .agg(_any(c.is_subscription(F.col("price_type_group"))).alias("subscriber")))
    per_customer = (per_performance.groupBy("summary_cust_id")
                    .agg(F.count("seen").alias("total_perfs"), F.max("subscriber").alias("subscriber")))
    return (per_customer.where((F.col("subscriber") == 0) & (F.col("total_perfs") > 0))
            .groupBy("total_perfs").agg(F.count("*").alias("total_customers")))


def audience_mix(tickets: DataFrame, this_fy: int, cutoff: str) -> DataFrame:
    """This year's audience up to a cut-off: subscribers by tenure, single buyers new or not."""
    fy, sub = F.col("fy"), F.col("price_type") == "Subscription"
    seats = (tickets.where((F.col("summary_cust_id") > 0)
                           & (F.col("perf_dt") <= F.lit(cutoff).cast("timestamp_ntz")))
             .select("summary_cust_id", c.fiscal_year(F.col("perf_dt")).alias("fy"),
                     c.subscription_or_single(F.col("price_type_group")).alias("price_type"))
             .where(fy.between(this_fy - 3, this_fy)))
    flags = seats.groupBy("summary_cust_id").agg(
        F.bool_or(fy == this_fy).alias("here"),
        F.bool_or((fy == this_fy) & sub).alias("holds"),
        F.bool_or(fy < this_fy).alias("came"),
        F.bool_or((fy < this_fy) & sub).alias("held_3"),
        F.bool_or((fy == this_fy - 1) & sub).alias("held_1"),
        F.bool_or((fy < this_fy - 1) & sub).alias("held_before"))
    tenure = c.tenure_class(F.col("held_3"), F.col("held_1"), F.col("held_before"))
    return (flags.where("here")
            .select("summary_cust_id", F.when(F.col("holds"), "subscriber").otherwise("single").alias("buyer"),
                    F.when(F.col("holds"), tenure).when(F.col("came"), "known").otherwise("new").alias("class")))


def single_buyers(tickets: DataFrame, this_fy: int, cutoff: str) -> DataFrame:
    """This year's customers without a subscription: a set difference of two key sets."""
    fy = c.fiscal_year(F.col("perf_dt"))
    here = tickets.where((F.col("summary_cust_id") > 0) & (fy == this_fy)
                         & (F.col("perf_dt") <= F.lit(cutoff).cast("timestamp_ntz")))
    holders = here.where(c.is_subscription(F.col("price_type_group")))
    return keys.drop_members(keys.key_set(here, "summary_cust_id"), keys.key_set(holders, "summary_cust_id"),
                             "summary_cust_id")


def audience_mix_counts(mix: DataFrame) -> DataFrame:
    return mix.groupBy("buyer", "class").agg(F.count("*").alias("customers"))


def age_group_summary(tickets: DataFrame, subscriber_tickets: DataFrame, birth_years: DataFrame,
                      donations: DataFrame, as_of: str) -> DataFrame:
    """Buying and giving by age group and price type, in two levels: customer, then group.

    Single tickets of customers who also hold a subscription (in `subscriber_tickets`) are left out. Seats are
    reduced to one row per customer and type before any join.
    """
    paid = (F.col("paid_amt") > 0) & (F.col("summary_cust_id") != 0)
    holders = keys.key_set(subscriber_tickets.where(paid & (F.col("price_type_group") == c.RAW_SUBSCRIPTION)),
                           "summary_cust_id")
    per_type = (tickets.where(paid & (F.col("perf_dt") <= F.lit(as_of).cast("timestamp_ntz")))
                .groupBy("summary_cust_id", "price_type_group")
                .agg(F.count("*").alias("tix"), F.sum("paid_amt").alias("paid"),
                     F.sum(c.attended_flag(F.col("attended"))).alias("came")))
    kept = (keys.flag_members(per_type, holders, "summary_cust_id", "holder")
            .where(~((F.col("price_type_group") == c.RAW_SINGLE) & F.col("holder"))))
    ages = (birth_years.where(F.col("key_value") > 0)
            .select(F.col("customer_no").alias("summary_cust_id"), c.age_group(F.col("key_value")).alias("age_group")))
    given = F.coalesce("gift_plus_pledge", F.lit(0.0))
    grouped = (kept.join(ages, "summary_cust_id").join(giving(donations), "summary_cust_id", "left")
               .withColumn("given", given)
               .groupBy("age_group", "price_type_group")
               .agg(F.count("*").alias("unique_customers"), F.sum("tix").alias("tix_transactions"),
                    # Sums of cents are rounded to the cent, so averages do not depend on the order of adding.
                    F.round(F.sum("paid"), 2).alias("paid_amt"), F.round(F.sum("given"), 2).alias("total_donations_5yr"),
                    F.try_divide(F.round(F.sum("given"), 2), F.count("*")).alias("average_donations_5yr"),
                    F.max("given").alias("max_5yr_donation_amt"),
                    F.sum("came").alias("attended")))
    return grouped.withColumns({
        "average_ticket_price": c.ratio(F.col("paid_amt"), F.col("tix_transactions")),
        "average_annual_donation": F.col("average_donations_5yr") / 5,
        "attendance_rate": c.ratio(F.col("attended"), F.col("tix_transactions"))})


def subscriptions_by_year(tickets: DataFrame, first_fy: int, last_fy: int) -> DataFrame:
    """Subscription and flex tickets per fiscal year."""
    held = tickets.where(c.is_subscription(F.col("price_type_group"))).select(
        c.short_fiscal_label(c.fiscal_year(F.col("perf_dt"), first_fy, last_fy)).alias("fy"), "price_type_group")
    return reshape.pivot_fixed(held, ["fy"], "price_type_group",
                               {"Flex": "flex", "Subscription": "subscription"}, F.count(F.lit(1)))


def paid_subscribers(tickets: DataFrame) -> DataFrame:
    """Paid subscription and flex tickets of known customers."""
    return tickets.where(c.is_subscription(F.col("price_type_group")) & (F.col("summary_cust_id") != 0)
                         & (F.col("paid_amt") > 0))


def first_time_subscribers(tickets: DataFrame, this_fy: int) -> DataFrame:
    """Subscribers of this year who held nothing the year before."""
    fy = c.fiscal_year(F.col("perf_dt"))
    years = (paid_subscribers(tickets).where(fy.isin(this_fy, this_fy - 1))
             .groupBy("summary_cust_id").agg(F.min(fy).alias("earliest")))
    return years.where(F.col("earliest") == this_fy).select("summary_cust_id", F.lit(True).alias("new_sub"))


def upgrade_prospects(tickets: DataFrame, donations: DataFrame, rules: AudienceRules, series: str) -> DataFrame:
    """Non-donors of the three best segments of a series who are not first-time subscribers."""
    seasons = series_seasons(rules.this_fy, series)
    mine = tickets.where(F.col("season_desc").isin(*seasons))
    fy, paying_sub = c.fiscal_year(F.col("perf_dt")), c.is_subscription(F.col("price_type_group")) & (
        F.col("paid_amt") > 0)
    counted = F.col("paid_amt") > rules.min_paid
    per_customer = (mine.where(F.col("summary_cust_id") > 0).groupBy("summary_cust_id")
                    .agg(F.count("*").alias("seats"), F.count_if(counted).alias("freq"),
                         F.sum(F.when(counted, F.col("paid_amt"))).alias("tot_paid_amt"),
                         _any(paying_sub & (fy == rules.this_fy)).alias("held_now"),
                         _any(paying_sub & (fy == rules.this_fy - 1)).alias("held_before"))
                    .where((F.col("seats") <= rules.seat_cap) & (F.col("freq") > 0))
                    .withColumn("avg_paid_amt", F.col("tot_paid_amt") / F.col("freq")))
    best = {c.AFICIONADO: "aficionado", c.REGULAR: "high value regular", c.PROSPECT: "high value prospect"}
    label = F.lit(None)
    for long, short in best.items():
        label = F.when(F.col("segment") == long, short).otherwise(label)
    total_gift = F.coalesce("gift_plus_pledge", F.lit(0.0))
    new_sub = (F.col("held_now") == 1) & (F.col("held_before") == 0)
    return (with_segment(per_customer).where(F.col("segment").isin(*best) & ~new_sub)
            .join(giving(donations), "summary_cust_id", "left").where(total_gift == 0)
            .select("summary_cust_id", "freq", "avg_paid_amt", "tot_paid_amt", label.alias("cust_seg"),
                    (F.col("held_now") == 1).alias("subscriber"), total_gift.alias("total_gift")))
